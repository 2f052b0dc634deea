import json
import struct

import pytest
from pyspark.sql import functions as F

from factloom.plans.verdict import Refusal
from factloom.sources import config, corpus, macho, stores
from factloom.streaming import pseudocode

GOOD = {"schema": 1, "requires": "0.2", "collections": [{"path": "docs/re", "kind": "evidence"}, {"path": "docs/concepts", "kind": "concept"}, {"path": "src", "kind": "code", "extensions": [".h"]}], "seals": {"tags": ["BIN", "KIT"], "imageTag": "BIN"}}


def test_config():
    c = config.parse(json.dumps(GOOD).encode())
    assert c.tags == ("BIN", "KIT") and c.collections[2].extensions == (".h",) and len(c.sha256) == 64
    bad = [{"schema": 2}, {"requires": "1"}, {"collections": []}, {"extra": 1}, {"seals": {"tags": ["bin"]}}, {"seals": {"tags": ["A"], "imageTag": "B"}}, {"collections": [{"path": "../x", "kind": "evidence"}]}, {"collections": [{"path": "x", "kind": "code"}]}, {"collections": [{"path": "x", "kind": "evidence", "extensions": [".h"]}]}, {"collections": [{"path": "/x", "kind": "evidence"}]}, {"towers": "a/../../b"}]
    for change in bad:
        with pytest.raises(Refusal):
            config.parse(json.dumps(GOOD | change).encode())
    with pytest.raises(Refusal):
        config.parse(b"{")


@pytest.mark.parametrize(("required", "running", "ok"), [("0.2", "0.2.0", True), ("0.2", "0.2.7", True), ("1.2", "1.3.0", True), ("1.2.3", "1.2.3", True), ("0.2.1", "0.2.0", False), ("0.3", "0.2.0", False), ("0.1", "0.2.0", False), ("2.0", "1.9.9", False), ("1.4", "1.3.0", False), ("0.2", "1.2.0", False)])
def test_requirements(required, running, ok):
    assert config.accepts(required, running) is ok


@pytest.mark.parametrize("text", ["1", "0.x", "0.2.", "", "0.2.0.1"])
def test_malformed_requirements(text):
    with pytest.raises(Refusal):
        config.accepts(text, "0.2.0")


@pytest.fixture
def tree(tmp_path):
    files = {"docs/re/one.md": "# 1 First\nsee 0x27c198c20\n## 1.1 Inner\n`A.b`\n", "docs/re/README.md": "# no", "docs/re/sub/x.md": "# no", "docs/concepts/c.md": "---\ntitle: Concept\naliases: [0x27c198c20, Other]\n---\ntext `C.d`\n", "src/a.h": "// [BIN] Kit @ 0x27c198c20\nint x;\n", "src/build/b.h": "// [KIT] no\n", "src/c.txt": "// [KIT] no\n", "docs/re/empty.md": "prose only\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    return tmp_path


def test_corpus(spark, tree):
    tables = corpus.build(spark, str(tree), config.parse(json.dumps(GOOD).encode()))
    assert {r["path"] for r in tables["file"].collect()} == {"docs/re/one.md", "docs/re/empty.md", "docs/concepts/c.md", "src/a.h"}
    assert {(r["file"], r["title"]) for r in tables["section"].collect()} == {("docs/re/one.md", "First"), ("docs/re/one.md", "Inner"), ("docs/concepts/c.md", "Concept")}
    assert tables["citation"].where(F.col("address") == 0x27C198C20).count() == 2
    assert {r["symbol"] for r in tables["citation"].where("symbol IS NOT NULL").collect()} == {"A.b", "C.d", "Other"}
    assert [(r["tag"], r["image"], r["address"]) for r in tables["seal"].collect()] == [("BIN", "Kit", 0x27C198C20)]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(Refusal, match="no store"):
        stores.Store(spark, path, "Documents")
    stores.write(spark, path, "Documents", {"seal": spark.range(3)}, {"ConfigSha256": "a"})
    old = stores.Store(spark, path, "Documents", ConfigSha256="a")
    stores.write(spark, path, "Documents", {"seal": spark.range(5)})
    assert old.table("seal").count() == 3 and stores.Store(spark, path, "Documents").table("seal").count() == 5
    for kind, identity in (("Catalog", {}), ("Documents", {"ConfigSha256": "b"})):
        with pytest.raises(Refusal, match="Mismatch"):
            stores.Store(spark, path, kind, **identity)
    with pytest.raises(Refusal):
        old.table("nothing")
    assert stores.disk_bytes(spark, path) > 0


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "facts")
    stores.replace_image(spark.createDataFrame([(1, 1), (2, 2)], "image_id long, v long"), path)
    stores.replace_image(spark.createDataFrame([(2, 9)], "image_id long, v long"), path)
    assert {(r["image_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, 1), (2, 9)}


def test_heads(tmp_path):
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    with pytest.raises(Refusal):
        corpus.head(str(tmp_path))
    (git / "packed-refs").write_text("# pack\nabc refs/heads/main\n")
    assert corpus.head(str(tmp_path)) == "abc"
    (git / "refs/heads/main").write_text("def\n")
    assert corpus.head(str(tmp_path)) == "def"
    tree = tmp_path / "tree"
    (git / "worktrees/t").mkdir(parents=True)
    tree.mkdir()
    (tree / ".git").write_text(f"gitdir: {git}/worktrees/t\n")
    (git / "worktrees/t/HEAD").write_text("ref: refs/heads/main\n")
    (git / "worktrees/t/commondir").write_text("../..\n")
    assert corpus.head(str(tree)) == "def"
    (git / "HEAD").write_text("0123\n")
    assert corpus.head(str(tmp_path)) == "0123"


def image() -> bytes:
    """A small Mach-O file: one text segment with two words, one symbol, encoded starts."""
    name = lambda s: s.encode().ljust(16, b"\0")
    section = name("__text") + name("__TEXT") + struct.pack("<2Q", 0x1000, 8) + bytes(32)
    segment = struct.pack("<2I", 0x19, 72 + 80) + name("__TEXT") + struct.pack("<4Q4I", 0x1000, 8, 400, 8, 5, 5, 1, 0) + section
    symtab, starts = struct.pack("<6I", 2, 24, 408, 1, 424, 8), struct.pack("<4I", 0x26, 16, 432, 3)
    head = struct.pack("<8I", 0xFEEDFACF, 0x0100000C, 0, 6, 3, len(segment + symtab + starts), 0, 0)
    body = (head + segment + symtab + starts).ljust(400, b"\0")
    return body + struct.pack("<2I", 0xD65F03C0, 0x94000002) + struct.pack("<IBBHQ", 1, 0x0F, 1, 0, 0x1000) + b"\0_main\0\0" + bytes([4, 4, 0])


def test_images(spark, tmp_path):
    (tmp_path / "a").write_bytes(image())
    path = str(tmp_path)
    rows = {t: [tuple(r)[1:] for r in macho.read(spark, path, t).collect()] for t in ("segment", "section", "symbol", "word")}
    assert rows["segment"] == [("__TEXT", 0x1000, 8)] and rows["section"] == [("__TEXT.__text", 0x1000, 8)] and rows["symbol"] == [("_main", 0x0F, 0x1000)]
    assert rows["word"] == [(0x1000, 0xD65F03C0), (0x1004, 0x94000002)]
    r = macho.read(spark, path, "function_starts").first()
    assert (r["base"], bytes(r["bytes"])) == (0x1000, bytes([4, 4, 0]))
    cache = (b"dyld_v1  arm64e\0" + struct.pack("<2I", 0x68, 2)).ljust(0x58, b"\0") + bytes(range(16)) + struct.pack("<3Q2I", 0x180000000, 64, 0, 5, 5) * 2
    assert macho.mappings(cache) == [(0x180000000, 64, 0)] and macho.cache_uuid(cache) == bytes(range(16)).hex()
    for broken in (b"", b"\0" * 64, image()[:40]):
        with pytest.raises(macho.Malformed):
            macho.segments(broken)


def test_streaming(spark, tmp_path):
    inbox, store, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = "1L AS image_id, 5L AS function, 'a' AS pseudocode, 1L AS plain, 'Ok' AS status, cast(NULL AS string) AS reason, 0.5D AS seconds"
    for at, text in (("2026-01-01 00:00:00", "a"), ("2026-01-01 00:05:00", "b")):
        spark.sql(f"SELECT {rows.replace(chr(39) + 'a' + chr(39), chr(39) + text + chr(39))}, timestamp'{at}' AS written FROM range(2)").write.mode("append").parquet(inbox)
        pseudocode.append(pseudocode.once(pseudocode.incoming(spark, inbox)), store, checkpoint).awaitTermination()
    kept = spark.read.parquet(store)
    assert kept.count() == 2 and pseudocode.current(kept).first()["pseudocode"] == "b"
    assert pseudocode.progress(kept).count() == 1
