import json

from factloom.plans import builds
from factloom.plans.verdict import FOUND, PARTIAL
from factloom.sources import config
from factloom.sources.stores import Store
from tests.test_sources import GOOD, image, tree  # noqa: F401


def test_facts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_bytes(image())
    store = str(tmp_path / "store")
    v = builds.build_facts(spark, str(tmp_path / "in"), store)
    assert (v.kind, v.count, v.read, v.total) == (FOUND, 1, 2, 2)
    opened = Store(spark, store, "Catalog")
    assert [(r["address"], r["size"]) for r in opened.table("function").orderBy("address").collect()] == [(0x1004, 4), (0x1008, 0)]
    assert [(r["site"], r["caller"], r["target"], r["via"]) for r in opened.table("call").collect()] == [(0x1004, 0x1004, 0x100C, "Unresolved")]
    assert [r["name"] for r in opened.table("symbol").collect()] == ["_main"]
    (tmp_path / "in/b").write_bytes(image())
    again = builds.build_facts(spark, str(tmp_path / "in"), store, resume=True)
    assert again.count == 2 and Store(spark, store, "Catalog").table("function").count() == 4


def test_documents(spark, tree, tmp_path):  # noqa: F811
    v = builds.build_documents(spark, str(tree), config.parse(json.dumps(GOOD).encode()), str(tmp_path / "docs"), head="abc")
    assert (v.kind, v.count, v.read, v.total) == (FOUND, 3, 4, 4)
    assert Store(spark, str(tmp_path / "docs"), "Documents", Head="abc").table("seal").count() == 1


def test_next_batch(spark):
    work = spark.createDataFrame([(1, 30, None, "c"), (2, 10, None, "b"), (3, 10, "t", "a"), (4, 5, None, "d")], "function long, bytes long, tower string, name string")
    assert [r["function"] for r in builds.next_batch(work, spark.createDataFrame([(4,)], "function long"), 2).collect()] == [3, 2]


def test_failed_images_are_recorded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_bytes(image())
    (tmp_path / "in/broken").write_bytes(image()[:40])
    v = builds.build_facts(spark, str(tmp_path / "in"), str(tmp_path / "store"), demangle=lambda n: n.strip("_") or None)
    assert (v.kind, v.exit_code, v.read, v.total) == (PARTIAL, 3, 2, 2) and "1 of 2 images failed" in v.why
    opened = Store(spark, str(tmp_path / "store"), "Catalog")
    rows = {r["path"].rsplit("/", 1)[-1]: (r["facts_state"], r["reason"]) for r in opened.table("image").collect()}
    assert rows["a"] == ("FactsDone", None) and rows["broken"][0] == "FactsFailed" and "outside" in rows["broken"][1]
    assert [r["demangled"] for r in opened.table("symbol").collect()] == ["main"]
    (tmp_path / "in/broken").write_bytes(image())
    assert builds.build_facts(spark, str(tmp_path / "in"), str(tmp_path / "store"), resume=True).count == 2


def test_pseudocode_is_resumed(spark, tmp_path):
    work = spark.createDataFrame([(0, k, 10 * k, None, f"n{k}") for k in range(7)], "image_id long, function long, bytes long, tower string, name string")
    store, seen = str(tmp_path / "code"), []

    def decompile(row):
        if row["function"] == 3:
            raise ValueError("refused")
        return f"int f{row['function']}();\n", "Ok", None, 0.1

    assert builds.pseudocode(spark, store)[1] is False
    first = builds.build_pseudocode(spark, work.where("function < 4"), decompile, store, size=3)
    assert (first.count, first.read, first.total) == (4, 3, 4) and builds.pseudocode(spark, store)[1]
    spark.createDataFrame([("0",)], "value string").coalesce(1).write.mode("overwrite").text(f"{store}/complete")
    again = builds.build_pseudocode(spark, work, decompile, store, size=2)
    rows, complete = builds.pseudocode(spark, store)
    assert again.count == rows.count() == rows.select("function").distinct().count() == 7 and complete and not seen
    assert [(r["status"], r["reason"]) for r in rows.where("function = 3").collect()] == [("Failed", "refused")]
