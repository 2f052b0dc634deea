import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontamination, html_text, packing, quality

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts}


def test_packing(docs, texts):
    ids, size = whole(texts), 512
    rows = packing.pack(docs, TOKENIZER, size=size).collect()
    found, sequences = {}, {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["start"] == r["piece"] * size and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        found.setdefault(r["doc_id"], []).append(r["length"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {i: sum(n) for i, n in found.items()} == {i: len(x) for i, x in ids.items()}
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    assert len(sequences) <= 1.1 * sum(map(len, ids.values())) / size + 1


def test_plan_fills_exactly():
    rng = np.random.default_rng(8)
    for _ in range(60):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 65, 20), rng.integers(1, 90, 20), strict=True)}
        bins, seen = {}, {}
        for length, first, n, sequence, offset, copies in packing.plan(counts, 64):
            assert first == seen.get(length, 0)
            seen[length] = first + n
            for r in range(n):
                bins.setdefault(sequence + r // copies, []).append((offset + r % copies * length, length))
        assert seen == counts and sorted(bins) == list(range(len(bins)))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 64
        large = sum(v for k, v in counts.items() if k > 32)  # no two of them share a sequence
        assert len(bins) <= 1.25 * max(large, sum(k * v for k, v in counts.items()) / 64) + 1


def test_packing_odd(odd, empty):
    assert packing.pack(odd, TOKENIZER).where("piece = 0").count() == odd.count()
    assert packing.pack(empty, TOKENIZER).collect() == []


def test_encoder_on_odd_words():
    e = packing.encoder(TOKENIZER)
    odd = ["It's 3²½ ªº <|endoftext|> İstanbuĺ é \x1c a\tb\xa0c 'RE'll", "日本語 ﬁ Ǆ", "", " ", "​x", "don't  STOP!!\r\nnow", "<|endoftext|> x", "a<|startoftext|>b  <|endoftext|>", "<|ENDOFTEXT|> é <|endoftext|", "日本<|endoftext|>語"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    assert e.ids(odd) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd]


def test_templates(spark):
    item = "A farmer called Alice has 12 apples and sells 5 apples to her friend Bob for 3 dollars each day"
    items = [(0, item), (1, "nothing of this stands anywhere in the documents at all today"), (2, None), (3, "")]
    texts = [
        "Intro. " + item + " and more text follows.",
        "Intro. A farmer called Carol has 40 apples and sells 9 apples to her friend Dave for 7 euros each day. End",
        "A farmer called Carol has 40 apples and sells 9 apples to her friend Carol for 40 euros each day",
        "A farmer called someone has some apples", None, "",
        item.upper(),
    ]
    rows = {r["doc_id"]: r for r in decontamination.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert rows[0]["item_id"] == 0 and rows[0]["n_changed"] == 0 and rows[0]["coverage"] == 1
    assert rows[1]["n_changed"] > 0 and rows[1]["coverage"] >= 0.9
    assert set(rows) == {0, 1, 2, 6} and rows[2]["n_changed"] > 0  # two values of the item may become one; capitals are found by plain windows


def test_leaks_against_brute_force(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))

    def grams(text):
        w = text.lower().split()
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}

    own = {r["item_id"]: grams(r["text"]) for r in items.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, g in own.items() if len(g & grams(r["text"])) > 0.6 * len(g)}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.decontaminate(docs, items).collect()}
    assert want and want == got
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert got == {(r["doc_id"], r["item_id"]) for r in decontamination.decontaminate(docs, items).collect()}


def test_templates_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two three four five six"), (None, None), (1, "one two three four five six")], "item_id long, text string")
    assert decontamination.decontaminate(odd, items).collect() == []
    assert decontamination.decontaminate(empty, items).collect() == []
    assert decontamination.decontaminate(odd, items.where("false")).collect() == []


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert quality.classify(empty, labels).collect() == []
    assert all(r["score"] == 1 for r in quality.classify(odd, labels.where("false")).collect())


def test_flat_trees_equal_walking():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5))
    y = (x[:, 1] + 0.3 * x[:, 3] > 0).astype(float)
    trees = quality.fit(x, y)

    def walk(row):
        total = trees.prior
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > t[at])
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))

    score = trees.score(x)
    assert np.allclose(score, [walk(r) for r in x]) and ((score > 0.5) == y).mean() > 0.95


PAGE = """<html><head><title>T</title><script>if (a<b) { x("</p>"); }</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to make it better.</p></div><article><h1>A &amp; B</h1><p>First <b>bold</b>
 paragraph&nbsp;here.<p>Second<br>line<aside><p>Related things</p></aside><div class="ad">Buy now</div><form><p>Your mail</p></form><p>Last one.</article>
<div id="comments"><p>I liked this article very much, thank you for writing it.</p></div><footer><p>&copy; all rights</p></footer></body>"""


def test_main_text(spark):
    pages = [(0, "u", PAGE), (1, None, None), (2, "u", ""), (None, "u", "<article><p>cut <a href='x"), (4, "u", "<article><p>a &lt;b&gt; &am</p></article")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    assert got[0]["text"] == "A & B\n\nFirst bold paragraph here.\n\nSecond line\n\nLast one."
    assert got[1]["text"] == got[2]["text"] == "" and got[None]["text"] == "cut" and got[4]["text"] == "a <b> &am"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract_text(df.where("false")).collect() == []


def test_marginals_equal_enumeration():
    model = html_text.Model(html_text.labelled_pages(60))
    page = html_text.Page("<body><div><p>some words of text here</p><ul><li><a href='x'>go</a></li></ul></div><article><p>more words</p></article></body>")
    n = len(page.tag)
    local, table = [(1.0, 1e-6)], [None]
    for k, (features, kind) in enumerate(page.features()):
        if k:
            local.append((1.0, float(np.exp(sum(model.feature.get(f, 0.0) for f in features)))))
            table.append(model.edge.get(kind, model.unseen))
    weight = np.zeros((n, 2))
    for state in range(2**n):
        y = [(state >> k) & 1 for k in range(n)]
        p = float(np.prod([local[k][y[k]] for k in range(n)]) * np.prod([table[k][2 * y[page.parent[k]] + y[k]] for k in range(1, n)]))
        for k in range(n):
            weight[k, y[k]] += p
    assert np.allclose(model.marginals(page), weight[:, 1] / weight.sum(1))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c
    from factloom.llm.near_dedup import near_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = c.keep_quality(spark, docs, sf_dir)
    assert good.columns == docs.columns
    once = c.drop_copies(spark, good, sf_dir)
    apart = c.drop_near_copies(spark, once, sf_dir)
    assert near_dedup(apart).where("NOT kept").isEmpty()
    clean = c.drop_benchmark(spark, apart, sf_dir)
    assert decontamination.decontaminate(clean, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).isEmpty()
    left = {r[0] for r in clean.select("doc_id").collect()}
    assert left == {r[0] for r in c.run(spark, sf_dir).select("doc_id").collect()} and len(left) < docs.count()


def test_copies_in_other_case(spark):
    item = "Yesterday the farmer Alice Müller sold Bob Ärmel and Carol Jones of Old Town twelve apples and five pears at noon"
    docs = spark.createDataFrame([(0, "X " + item.upper() + " END"), (1, "x " + item.lower() + " end"), (2, "THE FARMER SOLD SOMETHING ELSE IN OLD TOWN AT NOON")], "doc_id long, text string")
    rows = decontamination.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(0, 7), (1, 7)} and all(r["n_changed"] == 0 and r["coverage"] == 1 for r in rows)


def test_omitted_head_end_and_unclosed_buttons():
    model = html_text.Model(html_text.labelled_pages())
    story = "<article><h1>Title here</h1><p>The first paragraph has several words in it.</p><p>So has the second one.</p></article>"
    want = "Title here\n\nThe first paragraph has several words in it.\n\nSo has the second one."
    for start in ("<html><head><title>T</title><meta charset=x><body>", "<head><title>T</title><style>p{}</style>", "<head><title>T</title></head><body>"):
        assert model.extract(start + story) == want
    for control in ("<button>Go", "<select><option>One<option>Two", "<button><div>Go</div></button>", "<select><option>One</select>"):
        assert model.extract("<body>" + control + story) == want


def walked(item, text, monkeypatch=None):
    """Share of an item's windows in a text by plain loops: every alignment, majority of slots, either family."""
    import pyarrow as pa

    def listed(t, plain):
        if plain:
            h, _, pos = decontamination.plain_windows(pa.array([t]))
            return [(int(x), int(p), ()) for x, p in zip(h, pos, strict=True)]
        h, _, pos, values = decontamination.template_windows(pa.array([t]))
        return [(int(x), int(p), tuple(v)) for x, p, v in zip(h, pos, values.tolist(), strict=True)]

    best = 0.0
    for plain in (False, True):
        own, found = listed(item, plain), set()
        if not own:
            continue
        shifts = {}
        for h, p, v in listed(text, plain):
            for g, q, u in own:
                if g == h:
                    shifts.setdefault(p - q, []).append((q, u, v))
        for windows in shifts.values():
            votes = {}
            for _, u, v in set(windows):
                for a, b in {(a, b) for a, b in zip(u, v, strict=True) if a}:
                    votes.setdefault(a, {}).setdefault(b, 0)
                    votes[a][b] += 1
            first = {a: sorted(c, key=lambda b: (-c[b], b != a, b))[0] for a, c in votes.items()}
            found |= {q for q, u, v in windows if all(first[a] == b for a, b in zip(u, v, strict=True) if a)}
        best = max(best, len(found) / len({q for _, q, _ in own}))
    return best


ITEM = "A farmer called Alice has 12 apples and sells 5 apples to her friend Bob for 3 dollars each, then Alice walks 7 miles to the old market near the river and buys 5 new baskets for her sister Carol"


def test_one_changed_number_leaves_the_rest(spark):
    """An item that holds a number twice is found with one of the two changed; random re-parameterisations agree with plain loops."""
    import random

    rng = random.Random(8)
    texts = ["Intro. " + ITEM.replace("5 new", "6 new") + " and more.", ITEM.replace("12", "7").replace(" 5 ", " 7 "), ITEM.replace("Alice", "Zoe").replace("Bob", "Zoe")]
    for _ in range(25):
        text = "".join(w if not w.strip().isdigit() or rng.random() < 0.4 else f"{rng.randint(1, 9)} " for w in [x + " " for x in ITEM.split(" ")])
        words = text.split(" ")
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(("Dora", "and", "8", "the"))
        texts.append(" ".join(words))
    items = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: r["coverage"] for r in decontamination.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect()}
    want = {k: c for k, t in enumerate(texts) if (c := walked(ITEM, t)) >= decontamination.COVERAGE}
    assert got == pytest.approx(want) and {0, 1, 2} <= set(got) and len(got) < len(texts)


def test_names_at_sentence_starts(spark):
    item = "Anna has 12 apples in a bag. Anna buys 5 more at the shop. How many apples does Anna have now?"
    docs = spark.createDataFrame([(0, item.replace("Anna", "Beth").replace("12", "9"))], "doc_id long, text string")
    (row,) = decontamination.decontaminate(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert row["coverage"] == 1 and row["n_changed"] == 2


def article_of(html):
    """Main text by an independent reader: the blocks of the article element, without the inline adverts."""
    from html.parser import HTMLParser

    inline = set("a b i em strong span br code small sub sup u".split())

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.blocks, self.now = 0, [], []

        def cut(self):
            text = " ".join("".join(self.now).split())
            self.blocks += [text] if text else []
            self.now = []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag not in inline:
                self.cut()

        def handle_endtag(self, tag):
            if tag not in inline:
                self.cut()
            self.depth -= tag == "article"

        def handle_data(self, data):
            if self.depth:
                self.now.append(data)

    r = Reader()
    r.feed(html or "")
    r.close()
    return "\n\n".join(r.blocks)


def test_main_text_against_an_independent_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = html_text.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) > 100 and all(r["text"] == article_of(r["html"]) for r in rows)


def test_repeated_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE)] * 3 + [(1, "v", "<article><p>Other words here.</p></article>")], "page_id long, url string, html string").withColumns({"n_chars": F.lit("x"), "text": F.lit(0)})
    got = sorted((r["url"], r["n_chars"]) for r in html_text.extract_text(df).collect())
    assert [u for u, _ in got] == ["u", "u", "u", "v"] and len({n for u, n in got if u == "u"}) == 1 and html_text.extract_text(df).columns == ["page_id", "url", "text", "n_chars"]
