import random
import time

import pytest

from factloom.operators import asof, documents, fts, grep, lookup, stores
from factloom.plans.verdict import EMPTY, FOUND, NOT_VERIFIED, PARTIAL, Answer, Verdict


@pytest.mark.parametrize("bucket", [7, 100, 1 << 18])
def test_asof_against_brute_force(spark, bucket):
    rng = random.Random(bucket)
    right = sorted({(rng.randint(0, 2), rng.randint(0, 500)) for _ in range(60)})
    left = [(rng.randint(0, 3), rng.randint(-20, 600)) for _ in range(200)] + [(None, 5), (1, None)]
    got = asof.asof_floor(spark.createDataFrame(left, "g long, k long"), spark.createDataFrame([(g, a, a + 1) for g, a in right], "g long, a long, v long"), ["g"], "k", "a", bucket).collect()
    want = [(g, k, max((a for h, a in right if h == g and k is not None and a <= k), default=None)) for g, k in left]
    assert sorted(map(repr, [(r["g"], r["k"], r["a"]) for r in got])) == sorted(map(repr, want))
    assert all(r["v"] == (r["a"] + 1 if r["a"] is not None else None) for r in got)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_range_join_against_brute_force(spark, how):
    rng = random.Random(9)
    spans = [(k, rng.randint(0, 900), rng.choice((0, 5, 50, 400))) for k in range(40)]
    keys = [(rng.randint(-50, 1400),) for _ in range(150)]
    got = asof.range_join(spark.createDataFrame(keys, "at long"), spark.createDataFrame(spans, "s long, start long, size long"), "at", "start", "size", 64, how)
    hit = {k: [s for s, a, n in spans if a <= k < a + n] for (k,) in keys}
    want = {"inner": sum(len(hit[k]) for (k,) in keys), "left": sum(max(1, len(hit[k])) for (k,) in keys), "left_semi": sum(bool(hit[k]) for (k,) in keys), "left_anti": sum(not hit[k] for (k,) in keys)}
    assert got.count() == want[how]


def test_verdicts():
    assert [Verdict(FOUND, 3, read=1, total=2).line(), Verdict(EMPTY, read=2, total=2).line(), Verdict(EMPTY, read=1, total=2).line()] == ["verdict: FOUND 3  coverage 1/2", "verdict: EMPTY  coverage 2/2", "verdict: PARTIAL coverage incomplete  coverage 1/2"]
    assert [Verdict(k, read=1, total=2).exit_code for k in (FOUND, EMPTY, PARTIAL, NOT_VERIFIED)] == [0, 3, 3, 2]
    assert Verdict(NOT_VERIFIED, why="no store").line() == "verdict: NOT VERIFIED no store"
    assert '"verdict": "PARTIAL"' in Answer(Verdict(EMPTY, read=1, total=2)).to_json()


HEADINGS = "# §5. The inversion: the values\n\n## 5.1 The method\n\n```text\n# inside a fence\n```\n\n### Two families\n\n# §9b. The axis\n\n    #### indented\n\n\t### tab\n\n````text\n```\n## still inside\n````\n\n## Heading after\n#no space\n"


def test_headings():
    found = documents.parse_headings(HEADINGS)
    assert [(level, number, title) for _, level, number, title in found] == [(1, "5", "The inversion: the values"), (2, "5.1", "The method"), (3, None, "Two families"), (1, None, "§9b. The axis"), (2, None, "Heading after")]


def test_sections_keep_their_bytes(spark):
    df = spark.createDataFrame([("a.md", "# 1 First\r\nbody\r\n# 2 Second\r\nend\r\n"), ("b.md", "no heading"), ("c.md", "# A\nx\n## B\ny\n# C\n")], "file string, text string")
    got = {(r["file"], r["title"]): r for r in documents.sections(df).collect()}
    assert got["a.md", "First"]["text"] == "# 1 First\r\nbody\r\n" and got["a.md", "Second"]["text"] == "# 2 Second\r\nend\r\n"
    assert got["c.md", "A"]["text"] == "# A\nx\n## B\ny\n" and got["c.md", "B"]["last_line"] == 4 and len(got) == 5


def test_citations(spark):
    text = "`@0x27c198c20` and `Material.Configuration`, `Edge.resolve`; see `Window.h`, flags=0x00000052, 0x1a2b, `_$s7SwiftUI19Color`, `Assets/Icons.Bundle`, `Foo.MD`, 0x27c198c20 again, `Material.Configuration`"
    rows = documents.citations(spark.createDataFrame([(1, text), (2, "")], "section long, text string")).collect()
    assert [r["address"] for r in rows if r["address"]] == [0x27C198C20]
    assert {r["symbol"] for r in rows if r["symbol"]} == {"Material.Configuration", "Edge.resolve", "_$s7SwiftUI19Color"}


SOURCE = """// [BIN] KitOne island getter @ 0x22695fe48; initializer @ 0x22695fcf4.
int example = 0;

// The order is (@0x27c198c20, [BIN] Library)
// -- the same one.

int other = 1; // [KIT] layer "shadow" spacing 8

const char* fake = "// [BIN] NotASeal @ 0x22695fe48";

// [API] no address here.

    // [BIN] GlueTest tag only
    x; // @ 0x18a000030 glued address
{ // [OBS] marker @ 0x100002710
"""


def test_comment_blocks_and_seals(spark):
    lines = spark.createDataFrame([("f.h", k, t) for k, t in enumerate(SOURCE.split("\n"), 1)], "file string, line long, text string")
    rows = [(r["line"], r["tag"], r["image"], r["address"]) for r in documents.seals(documents.comment_blocks(lines), ["BIN", "KIT", "OBS", "API"], "BIN").orderBy("line", "address").collect()]
    assert rows == [(1, "BIN", "KitOne", 0x22695FCF4), (1, "BIN", "KitOne", 0x22695FE48), (4, "BIN", "Library", None), (7, "KIT", None, None), (11, "API", None, None), (13, "BIN", "GlueTest", 0x18A000030), (15, "OBS", None, None)]


def test_front_matter(spark):
    texts = [("a", "---\ntype: concept\ntitle: One\ntitle: Two\naliases: [x, \"y\"]\n---\nbody"), ("b", "no front"), ("c", "---\ntype: open\n"), ("d", "---\naliases:\n- x\n---\n")]
    got = {r["file"]: r for r in documents.front_matter(spark.createDataFrame(texts, "file string, text string")).collect()}
    assert (got["a"]["type"], got["a"]["title"], got["a"]["aliases"], got["a"]["closed"]) == ("concept", "Two", ["x", "y"], True)
    assert (got["b"]["title"], got["b"]["aliases"], got["b"]["closed"]) == (None, [], True)
    assert got["c"]["closed"] is False and got["d"]["aliases"] == []


def test_grep(spark):
    d = spark.createDataFrame([(0, 100, "a Foo\nfoo\nx MEMORY[0x10] y MEMORY[0x20]\n", 30), (0, 200, None, 0), (1, 300, "bar\n", 4)], "image_id long, function long, pseudocode string, plain long")
    crossing = spark.createDataFrame([(0x10, "_Foo"), (0x20, "_FooBar"), (0x30, "_Foo")], "island long, symbol string")
    rows = {(r["function"], r["line"]): r for r in grep.grep(d, "Foo", crossing).collect()}
    assert set(rows) == {(100, 1), (100, 3)} and rows[100, 3]["text"] == "x _Foo y MEMORY[0x20]" and rows[100, 3]["via_island"]
    assert {r["line"] for r in grep.grep(d, "FOO", ignore_case=True).collect()} == {1, 2}
    with pytest.raises(ValueError):
        grep.grep(d, "")


@pytest.mark.parametrize(("text", "want"), [("shadow pool", {1, 2}), ("SHADOW", {1, 2, 3}), ("ab shadow", {1, 2, 3}), ("ab AND shadow", set()), ("ab", set()), ("sha*", {1, 2, 3}), ('"w p"', {1}), ("shadow NOT pool", {3}), ("(pool OR other) NOT deep", {1, 4}), ("NEAR(pool shadow, 5)", {1, 2})])
def test_find(spark, text, want):
    df = spark.createDataFrame([(1, "a shadow pool"), (2, "pool shadow deep"), (3, "Shadow alone"), (4, "other words")], "id long, text string")
    assert {r["id"] for r in fts.find(df, text).collect()} == want


@pytest.mark.parametrize("text", ["Foo.Bar", "100%", "a-b", "AND x", "(abc", '"open'])
def test_find_refuses(text):
    with pytest.raises(fts.QueryError):
        fts.parse(text)


def test_short_queries():
    assert fts.too_short('"ab"') and fts.too_short(" a b ") and not fts.too_short("abc") and not fts.too_short("éb")


def test_trigrams(spark):
    """Grams of the folded text, also where folding makes it longer; a long text is read once."""
    texts = [(1, "\u0130ntti"), (2, "a\U0001f600bC\n"), (3, "ab"), (4, None), (5, "aaaa"), (6, "ttisntti"), (7, "x" * 500_000 + " conttis")]
    df = spark.createDataFrame(texts, "id long, text string")
    index = fts.trigrams(df.where("id < 7"))
    got = sorted((r["id"], r["gram"]) for r in index.collect())
    folded = {1: "i\u0307ntti", 2: "a\U0001f600bc\n", 5: "aaaa", 6: "ttisntti"}
    assert got == sorted((i, g) for i, t in folded.items() for g in {t[k : k + 3] for k in range(len(t) - 2)})
    assert {r["id"] for r in fts.candidates(index, "NTTI").collect()} == {1, 6}
    began = time.monotonic()
    assert {r["id"] for r in fts.candidates(fts.trigrams(df), "ntti", "ttis").collect()} == {6, 7}
    assert time.monotonic() - began < 60


def test_stores(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, size long, mtime long")
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, size long, mtime long")
    assert {(r["path"], r["fate"]) for r in stores.staleness(old, new).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    assert stores.upsert(old, new.where("path = 'b'"), ["path"]).where("path = 'b'").first()["size"] == 2
    names = lookup.store_names(spark.createDataFrame([("/x/K", 0), ("/y/K", 1), ("/x/K", 2), ("/z/L", 3)], "path string, position long"))
    assert {(r["path"], r["store"]) for r in names.collect()} == {("/x/K", "K.db"), ("/y/K", "K-2.db"), ("/z/L", "L.db")}


def test_image_names(spark):
    image = spark.createDataFrame([(0, "/System/Library/A"), (1, "/opt/A"), (2, "/opt/B"), (3, "/opt/x/B"), (4, "/opt/C")], "image_id long, path string")
    found = {name: [r["image_id"] for r in lookup.image_by_name(image, name).collect()] for name in ("A", "B", "C", "/opt/A", "D")}
    assert found == {"A": [0], "B": [], "C": [4], "/opt/A": [1], "D": []}
