import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import components, exact_dedup, kernels, near_dedup, substring_dedup


@pytest.mark.parametrize("fan_in", [2, 4, 16])
def test_exact(docs, texts, fan_in, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SEGMENT", 1)
    docs = docs.repartition(7)
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, fan_in).collect()}
    assert len(got) == len(texts)
    for i, t in norm.items():
        own = groups[t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(own), len(own), i == min(own))
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_merge_of_sorted_runs():
    """The multiway merge equals a dictionary, verifies all marks, and its runs stay sorted."""
    rng = np.random.default_rng(4)
    runs, want = [], defaultdict(list)
    for _ in range(9):
        rows = sorted({(bytes(rng.integers(0, 3, 2, np.uint8)), int(rng.integers(1, 3)), int(rng.integers(1, 3))) for _ in range(12)})
        run = [(*r, None if rng.random() < 0.2 else int(rng.integers(0, 99)), int(rng.integers(1, 5))) for r in rows]
        for r in run:
            want[r[:3]].append(r[3:])
        runs.append(run)
    got = list(exact_dedup.merged([iter(r) for r in runs]))
    assert [g[:3] for g in got] == sorted(want)
    for g in got:
        assert g[3:] == (min((i for i, _ in want[g[:3]] if i is not None), default=None), sum(n for _, n in want[g[:3]]))


def test_runs_are_sorted(docs):
    digests = docs.selectExpr("unhex(sha2(coalesce(text, ''), 256)) AS sha", "octet_length(coalesce(text, '')) AS bytes", "xxhash64(coalesce(text, '')) AS check", "doc_id").repartition(3)
    last = {}
    for r in exact_dedup.first_runs(digests, 8).collect():
        assert last.get(r["run"], b"") < r["sha"] and r["segment"] == r["sha"][0] >> 5
        last[r["run"]] = r["sha"]
    assert len(last) == 3


def test_exact_odd(odd, empty):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == odd.count() and all(not r["kept"] for r in rows if r["doc_id"] is None and r["keep_id"] is not None)
    assert exact_dedup.exact_dedup(empty).collect() == []


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()


def brute(texts):
    sets, parent = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [1024, 3])
def test_near(docs, texts, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "TEXT_ROWS", block)
    want = brute(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(docs).collect()}
    assert got == want
    assert any(c != i for i, (_, c) in want.items())


def test_near_without_broadcast(docs, texts, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(docs).collect()} == brute(texts)


def test_near_odd(odd, empty):
    rows = near_dedup.near_dedup(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["component_id"] is None and not r["kept"] for r in rows if r["doc_id"] is None)
    assert near_dedup.near_dedup(empty).collect() == []


def planted(n=300):
    """Texts around one template at every degree of likeness, in parts that hang together by few links, and copies of them."""
    rng = np.random.default_rng(7)
    base = made_words(rng, 120).split()
    texts = []
    for part in range(6):
        own = list(base)
        for k in rng.choice(120, 5 + 5 * part, replace=False):
            own[k] = made_words(rng, 1)
        for _ in range(n // 6):
            w = list(own)
            for k in rng.choice(120, rng.integers(0, 12), replace=False):
                w[k] = made_words(rng, 1)
            texts.append(" ".join(w[: rng.integers(90, 121)]))
    texts += texts[::9]
    return [(int(i), texts[k]) for k, i in enumerate(rng.permutation(len(texts)))]


@pytest.mark.parametrize("block", [1024, 20])
def test_near_in_large_groups(spark, block, monkeypatch):
    """A group of likeness in all degrees, whole or in many blocks, equals brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "TEXT_ROWS", block)
    texts = planted()
    want = brute(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and len({c for _, c in want.values()}) > 3


def test_connect_against_all_pairs():
    """Components of connect() equal those of all pairs, in one block and in two rounds of blocks."""
    rng = np.random.default_rng(6)
    for _ in range(40):
        n = int(rng.integers(6, 40))
        centre = rng.integers(0, 1 << 16, (3, near_dedup.SIZE), dtype=np.uint16)
        sig = centre[rng.integers(0, 3, n)].copy()
        for row in sig:
            at = rng.choice(near_dedup.SIZE, rng.integers(0, 45), replace=False)
            row[at] = rng.integers(0, 1 << 16, len(at))
        alike = rng.random((n, n)) < 0.7
        alike |= alike.T
        d = near_dedup.distances(sig, np.arange(n))
        assert (d == (sig[:, None] != sig[None]).sum(2)).all()
        a, b = np.nonzero((d <= near_dedup.DISTANCE) & alike)
        want = components.local_components(a, b, n)

        def agree(x, y, alike=alike):
            return alike[x, y]

        def label(links, n=n):
            x = np.array(links, np.int64).reshape(-1, 2)
            return components.local_components(x[:, 0], x[:, 1], n)

        assert (label(near_dedup.connect(sig, near_dedup.DISTANCE, agree)) == want).all()
        rows = [np.flatnonzero(np.arange(n) % 3 == k) for k in range(3)]
        links = [(r[x], r[y]) for r in rows for x, y in near_dedup.connect(sig[r], near_dedup.DISTANCE, lambda x, y, r=r: alike[r[x], r[y]])]
        before = label(links)
        out = near_dedup.Parts(before).outside()
        links += near_dedup.connect(sig, near_dedup.DISTANCE, agree, before, out)
        assert (label(links) == want).all()


def test_rows_sent_grow_with_the_group(spark):
    """A hot group of one part is sent once, with the pivots; what is outside its part adds the group once for each block of it."""
    n = 5000
    rows = spark.range(n).selectExpr("7L AS root", "id", f"cast(ceil({n} / 512) AS int) AS blocks").withColumn("pivot", near_dedup.F.col("id") < 4)
    sent = near_dedup.dealt(rows, "blocks")
    assert sent.count() == n - 4 + 4 * 10 and sent.groupBy("i").count().agg({"count": "max"}).first()[0] < 700
    parts = spark.range(n).selectExpr("7L AS root", "id", "if(id < 30, id, 30L) AS label", "1 / 512D AS weight")
    cross = near_dedup.crossed(parts, "root")
    assert cross.count() == n + 30 * 10
    assert near_dedup.crossed(parts.withColumn("label", near_dedup.F.lit(1)), "root").isEmpty()


def test_all_pairs_under_the_distance_share_a_key():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 16, (200, near_dedup.SIZE), dtype=np.uint16)
    assert near_dedup.DISTANCE == 2 * near_dedup.CHUNKS - 1
    for most in range(near_dedup.DISTANCE + 1):
        other = sig.copy()
        for row in other:
            row[rng.choice(near_dedup.SIZE, most, replace=False)] ^= 1
        same = (sig == other).reshape(200, near_dedup.CHUNKS, near_dedup.CHUNK).sum(2)
        assert (same.max(1) >= near_dedup.CHUNK - 1).all()


def test_word_hashes_do_not_depend_on_place():
    def hashes(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return kernels.doc_words(data, np.array([0, len(data)]))[3].tolist()

    one = hashes("alpha beta gamma")
    assert hashes("x " * 700_000 + "Alpha BETA\ngamma")[-3:] == one
    assert len(set(hashes(" ".join(f"w{k}" for k in range(50_000))))) == 50_000


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_substring(spark):
    rng = np.random.default_rng(2)

    def words(n):
        return " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n))

    shared, short = words(60), words(30)
    texts = [words(100) + " " + shared + " " + words(50), words(7) + " " + shared + words(80), words(200), short + " " + words(90), words(33) + " " + short, words(20) + " " + shared, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = substring_dedup.repeated_passages(df)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert set(rows) == {1, 5}
    for r in rows.values():
        assert r["keep_id"] == 0 and shared.rsplit(" ", 1)[0] in texts[r["doc_id"]][r["start"] : r["end"]] and r["n_words"] >= 59
        assert texts[r["doc_id"]][r["start"] : r["end"]] in texts[0]
    left = {r["doc_id"]: r["text"] for r in substring_dedup.cut_out(df, found).collect()}
    assert left[2] == texts[2] and shared[:200] not in left[1] and left[6] == ""


def test_chunks_resist_shifts():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(97, 123, 20_000)))
    digests = [Counter(substring_dedup.chunks(pa.array([t]))[3].tolist()) for t in (text, "inserted " + text[:9000] + "!" + text[9000:])]
    assert sum((digests[0] & digests[1]).values()) > 0.98 * sum(digests[0].values())
    of, at, length, _ = substring_dedup.chunks(pa.array([text, "", "ab", text[:777]]))
    assert np.bincount(of, length, 4).tolist() == [20_000, 0, 2, 777]


def test_substring_odd(odd, empty):
    rows = substring_dedup.repeated_passages(odd).collect()
    assert all(r["doc_id"] is not None for r in rows)
    assert substring_dedup.repeated_passages(empty).collect() == []


def passage_rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["doc_id"], r["keep_id"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in substring_dedup.repeated_passages(df).collect()]


def made_words(rng, n):
    return " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n))


def test_substring_run_that_is_not_contiguous(spark):
    rng = np.random.default_rng(6)
    x, p, y, z, q = (made_words(rng, 60) for _ in range(5))
    source, copy = " ".join((x, p, y, z, p, q)), " ".join((x, p, q))
    rows = [r for r in passage_rows(spark, [source, copy]) if r[0] == 1]
    assert all(keep == 0 and part in source for _, keep, part in rows)
    assert any(f"{x} {p}" in part for _, _, part in rows) and any(f"{p} {q}" in part for _, _, part in rows)
    within = [part for _, _, part in passage_rows(spark, [source + " " + made_words(rng, 20) + " " + copy])]
    assert any(f"{x} {p}" in part for part in within) and any(f"{p} {q}" in part for part in within)


def test_substring_lines_of_earlier_documents(spark):
    rng = np.random.default_rng(7)
    texts, want = [], {}
    for _ in range(40):
        a, b = made_words(rng, 35), made_words(rng, 35)
        texts += [f"{made_words(rng, 9)} {a} {made_words(rng, 9)}", f"{made_words(rng, 9)} {b} {made_words(rng, 9)}"]
        texts += [f"{made_words(rng, 9)} {a} {b} {made_words(rng, 9)}" for _ in range(2)]
        want[len(texts) - 1] = len(texts) - 2, f"{a} {b}"
    rows = passage_rows(spark, texts)
    assert {r[0] for r in rows} == set(want)
    assert all(keep == want[doc][0] and want[doc][1] in part for doc, keep, part in rows)


def test_substring_repeated_rows(spark):
    """A row that stands there twice counts once, as source and as copy; a second text of an id may be a copy of its first."""
    rng = np.random.default_rng(9)
    shared, other = made_words(rng, 70), made_words(rng, 60)
    source, copy = f"{made_words(rng, 9)} {shared} {made_words(rng, 9)}", f"{made_words(rng, 20)} {shared} {made_words(rng, 5)}"
    rows = [(5, source)] * 3 + [(6, copy)] * 2 + [(7, other), (7, made_words(rng, 12) + " " + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["keep_id"], r["n_words"] >= 60) for r in substring_dedup.repeated_passages(df).collect())
    assert got == [(6, 5, True), (7, 7, True)]


def longest_copies(texts, size):
    """Words of each text that lie in a window of `size` words which stands byte for byte in an earlier text, or earlier in the same one; by plain loops."""
    spans = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    seen, out = {}, {}
    for d, (t, own) in enumerate(zip(texts, spans, strict=True)):
        for k in range(len(own) - size + 1):
            window = t[own[k][0] : own[k + size - 1][1]]
            if seen.setdefault(window, (d, k)) != (d, k):
                out.setdefault(d, set()).update(range(k, k + size))
    return out, spans


def test_substring_against_brute_force(spark):
    """Words in reported passages are just those of windows that stand earlier, for texts that share passages of all lengths; passages are copies."""
    rng = np.random.default_rng(12)
    parts = [made_words(rng, int(n)) for n in rng.integers(20, 120, 14)]
    texts = []
    for _ in range(40):
        own = [parts[rng.integers(len(parts))] if rng.random() < 0.5 else made_words(rng, int(rng.integers(1, 60))) for _ in range(rng.integers(1, 6))]
        texts.append(" ".join(own))
    texts += ["", "word " * 400, made_words(rng, 49), "é ü " * 60]
    want, spans = longest_copies(texts, 50)
    got = {}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in substring_dedup.repeated_passages(df).collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] in texts[r["keep_id"]]
        words = {k for k, (a, b) in enumerate(spans[r["doc_id"]]) if a >= r["start"] and b <= r["end"]}
        assert len(words) == r["n_words"] >= 50
        got.setdefault(r["doc_id"], set()).update(words)
    assert set(got) == set(want)
    for d in want:
        assert want[d] <= got[d]


def test_substring_without_cuts(spark):
    """Short words: 50 of them hold no whole chunk, and their documents no repeated one."""
    rng = np.random.default_rng(21)
    shared = " ".join("".join(map(chr, rng.integers(97, 123, 1 + k % 2))) for k in range(50))
    texts = [f"{made_words(rng, 60)} {shared} {made_words(rng, 60)}" for _ in range(2)]
    assert not set.intersection(*(set(substring_dedup.chunks(pa.array([t]))[3].tolist()) for t in texts))
    assert [(doc, keep, shared in part) for doc, keep, part in passage_rows(spark, texts)] == [(1, 0, True)]


def test_marks(spark):
    """All of a set are marked and few others; in too few bits more others are, but still all of the set."""
    h = kernels.mix(np.arange(100_000, dtype=np.uint64))
    rows = spark.createDataFrame(pa.table({"h": h[:30_000].view(np.int64)}))
    for most, others in ((substring_dedup.MOST_BITS, 0.07), (substring_dedup.SEGMENT_BITS, 0.45)):
        found = substring_dedup.marked(substring_dedup.marks(rows, most).value, h)
        assert found[:30_000].all() and 0 < found[30_000:].mean() < others
    assert not substring_dedup.marked(substring_dedup.marks(rows.where("false")).value, h).any()


def exact_components(ids, sets):
    """Components of all pairs at a similarity of 0.75: every pair that shares one of its rarest shingles is compared (a pair at that similarity must)."""
    count = Counter(x for s in sets for x in s)
    lists, parent = defaultdict(list), {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in sorted(range(len(ids)), key=lambda k: len(sets[k])):
        own = sorted(sets[k], key=lambda x: (count[x], x))
        prefix = own[: len(own) - -(-75 * len(own) // 100) + 1]
        for j in {j for x in prefix for j in lists[x]}:
            p, q = find(ids[k]), find(ids[j])
            if p != q:
                both = len(sets[k] & sets[j])
                if 100 * both >= 75 * (len(sets[k]) + len(sets[j]) - both):
                    parent[max(p, q)] = min(p, q)
        for x in prefix:
            lists[x].append(k)
    return {i: find(i) for i in ids}


def test_near_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r["text"]) for r in rows]
    want = exact_components([r["doc_id"] for r in rows], sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(docs).collect()}
    assert got == {r["doc_id"]: (len(s), want[r["doc_id"]]) for r, s in zip(rows, sets, strict=True)}
