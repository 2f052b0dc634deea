import base64
import datetime
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import licenses, pii, secrets


def test_secret_scan(spark):
    key = "A94F0C3D2B7E81569A0B1C2D3E4F5A6B7C8D9E0F"
    texts = [f'token = "{"0a1b2c" * 7}" end', f"AKIA{'Z9' * 9} and {key}", "plain words only antidisestablishmentarianism", 'PassWord:"short" api-key=abcdef api_key = abcdef', "é Secret=A1b2C3 é", None, "", "4111111111111111 2024-01-01-2024-01-02", "ghp_" + "aZ9kQ3" * 6]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0]["n_assign"], got[0]["n_hex"]) == (1, 1) and got[0]["spans"] == "assign:0:51,hex:9:51"
    assert got[1]["n_access"] == 1 and got[1]["spans"] == f"access:0:22,hexkey:27:{27 + len(key)}"
    assert [got[k]["spans"] for k in (2, 5, 6, 7)] == [""] * 4
    assert got[3]["spans"] == "assign:32:48" and got[4]["spans"] == "assign:2:15"
    assert got[8]["spans"] == "github:0:40"
    for r in got.values():
        base = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in secrets.ORDER)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner()


def drawn(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def test_states_merge_and_keep_structure(scanner):
    """A fixed-length format keeps a state for each place; formats of varying lengths merge most of their tree."""
    states = {kind: (len(a.red), a.tree) for kind, a in scanner.automata}
    assert states["github"] == (37, 37) and states["gitlab"] == (21, 21)
    assert 2 < states["slack"][0] < states["slack"][1] / 3 and 10 < states["webtoken"][0] < states["webtoken"][1] / 10


def test_merging_finds_a_loop():
    """From (ab)* with geometric lengths the tree of many states becomes a few with a loop; all strings of that language are accepted."""
    rng = random.Random(1)
    values = ["key" + "a." * (1 + min(int(rng.expovariate(0.35)), 25)) for _ in range(800)]
    a = secrets.Automaton([v + "a" * 3 for v in values])
    assert len(a.red) < a.tree


def test_formats_are_told_from_look_alikes(scanner):
    rng = random.Random(99)
    right = defaultdict(list)
    for kind, value in secrets.labelled(seed=99, examples=30):
        right[kind].append(scanner.kind_of(value) == kind)
    assert all(sum(r) >= 0.95 * len(r) for r in right.values())  # a short key may look like words
    rejected = [
        lambda: "ghp_" + drawn(rng, secrets.ALNUM, 14), lambda: "ghp_" + drawn(rng, secrets.ALNUM, 37), lambda: drawn(rng, secrets.ALNUM, 20), lambda: drawn(rng, secrets.HEX_UP, 36), lambda: drawn(rng, secrets.NUM, 32),
        lambda: "-".join(drawn(rng, secrets.HEX_LOW, n) for n in (8, 4, 4, 4, 12)), lambda: drawn(rng, secrets.LOW, 32), lambda: "xoxb-" + drawn(rng, secrets.ALNUM, 48),
    ]
    for make in rejected:
        assert not any(scanner.found(make()) for _ in range(60))
    caught = [
        lambda: base64.b64encode(rng.randbytes(32)).decode(), lambda: base64.b64encode(rng.randbytes(16)).decode(), lambda: drawn(rng, secrets.LOW + secrets.UP, 40),
        lambda: ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"%d","admin":true,"iat":1516239022}' % rng.randrange(10**9), rng.randbytes(32))),
    ]
    for make in caught:
        assert sum(scanner.kind_of(make()) is not None for _ in range(60)) >= 57
    assert not any(scanner.found(v) for v in secrets.ordinary(seed=123))


def test_candidates_within_runs(scanner):
    """A credential is found behind a name and a separator, at a sentence's end, in a path; its neighbours stay out."""
    rng = random.Random(5)
    key, token = drawn(rng, secrets.ALNUM, 40), "ghp_" + drawn(rng, secrets.ALNUM, 36)
    for before, value, after in (("AWS_ACCESS_KEY=", key, ""), ("GITHUB_PAT=", token, ""), ("see ", token, "."), ("a/b/", key, "/c"), ("x?key=", "AIza" + drawn(rng, secrets.ALNUM, 35), "&y=z"), ("é ", token, " é")):
        base, more = scanner.scan(before + value + after)
        assert not base and [(s, e) for s, e, _ in more] == [(len(before), len(before) + len(value))]
    assert scanner.found("x" + token) == []


def test_data_is_no_key(scanner):
    """Pieces of base64 data have the form of keys by chance; a key with a prefix is found even there, and keys beside data are."""
    rng = random.Random(7)
    blob, key, token = base64.b64encode(rng.randbytes(30_000)).decode(), drawn(rng, secrets.ALNUM, 40), "ghp_" + drawn(rng, secrets.ALNUM, 36)
    assert scanner.scan(blob)[1] == [] and scanner.scan(blob * 3 + "==")[1] == []
    assert [k for _, _, k in scanner.scan(f"{blob}-{token}")[1]] == ["github"]
    assert [(s, e) for s, e, _ in scanner.scan(f"{key} {blob} x={key}")[1]] == [(0, 40), (len(blob) + 44, len(blob) + 84)]
    path = "/".join(secrets.WORDS)  # a long path is no data
    assert [k for _, _, k in scanner.scan(f"{path}/{key}/end")[1]] == ["random"]


def test_no_secrets_in_ordinary_documents(spark, scanner, sf_dir):
    """The words of the documents are no secrets: what is added there lies in runs that hold digits."""
    for sf in (sf_dir, "/root/testdata/sf0.01"):
        for (text,) in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
            base, more = scanner.scan(text or "")
            assert all(any(c.isdigit() for c in text[s:e]) for s, e, _ in more)
            words = re.sub("[0-9]", "", text or "")
            assert not scanner.scan(words)[1]


def walk_spans(text):
    """The fixed patterns by hand: from each place the longest match, left to right, without regular expressions."""
    names, low = ("password", "passwd", "secret", "token", "api_key", "apikey"), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out = []

    def run(at, letters):
        while at < len(text) and text[at] in letters:
            at += 1
        return at

    def assign(at):
        name = next((n for n in names if low.startswith(n, at)), None)
        if name is None:
            return None
        at += len(name)
        at += at < len(text) and text[at] in "\"'"
        at = run(at, " ")
        if at >= len(text) or text[at] not in ":=":
            return None
        at = run(at + 1, " ")
        at += at < len(text) and text[at] in "\"'"
        end = run(at, secrets.ALNUM + "+/_.=-")
        return (end, end - at) if end > at else None

    for kind, least, match in (
        ("assign", 6, assign), ("access", 20, lambda k: (e, e - k) if text.startswith("AKIA", k) and (e := run(k + 4, secrets.UP + secrets.NUM)) > k + 4 else None), ("hex", 24, lambda k: (e, e - k) if (e := run(k, secrets.HEX_LOW)) > k else None),
    ):
        at = 0
        while at < len(text):
            found = match(at)
            if found and found[1] >= least:
                out.append((at, ("assign", "access", "hex").index(kind), kind, found[0]))
            at = found[0] if found else at + 1
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_base_spans_against_a_walk(spark):
    """All contract columns of the fixed patterns, over texts strewn with pieces of them."""
    rng = random.Random(6)
    pieces = ["password", "passwd", "SECRET", "ToKen", "api_key", "apikey", "API-key", '"', "'", " ", "  ", ":", "=", ":=", "AKIA", "AKIAAKIA", "Z9" * 9, "0a1b2c" * 5, "deadbeef", "abc.def", "é", "\n", "x", "ABCDEF", "+/=", "token", "12345"]
    rows = [(k, "".join(rng.choices(pieces, k=rng.randint(0, 60)))) for k in range(400)] + [(900, None), (901, "")]
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = walk_spans(dict(rows)[r["doc_id"]] or "")
        listed = [f"{kind}:{s}:{e}" for kind, s, e in want]
        n = Counter(kind for kind, _, _ in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n["assign"], n["access"], n["hex"])
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert [x for x in every if x.split(":")[0] in secrets.ORDER] == listed and len(every) - len(listed) == r["n_added"]


def test_license_scan(spark):
    texts = ["released under the MIT  License. mit license", "Licensed under CC BY-NC 4.0.", "the general public license of words", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "under a license", None, "", "mité license", "This work is licensed under the GNU General Public License, version 3."]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["n_words"], got[0]["labels"]) == (2, 3, 5, 7, "mit")
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["labels"], got[1]["base_labels"]) == (0, None, "cc-by-nc", "")
    assert got[2]["base_labels"] == "gpl" and got[3]["labels"] == "mit" and got[3]["n_base"] == 0
    assert [got[k]["labels"] for k in (4, 5, 6, 7)] == [""] * 4 and got[8]["labels"] == "gpl"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_license_base_against_brute_force(docs, texts):
    """All contract columns, by plain loops over words; phrases are strewn over the texts too."""
    spark, rng = docs.sparkSession, random.Random(2)
    phrases = [p for p, _ in licenses.BASE] + ["the license", "MIT", "General  Public", "apache-license.", "mit_license", "MIT\nLicense"]
    rows = [(i, " ".join(x for w in (t or "").split(" ")[:300] for x in ([w, rng.choice(phrases)] if rng.random() < 0.05 else [w]))) for i, t in texts] + [(900, "é MIT license"), (901, "mit license" * 3), (902, None)]
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), dict(rows)[r["doc_id"]] or ""))
        hits = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in hits]
        base = sorted({label for _, label in hits})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(base))
        assert set(base) <= set(r["labels"].split(",")) and r["labels"] == ",".join(sorted(set(r["labels"].split(",")))) and (r["score"] == 1) >= bool(base)


def test_license_texts_in_files(spark):
    """Every template is found within other words, with a holder's name put in and some words changed; half a text is not."""
    from factloom.llm import license_texts

    rng = random.Random(3)
    fill = [w for t in "The story of a small town and its people, who use the river for all their work without any limit".split() for w in (t, "and")]
    rows, want = [], {}
    for k, (label, _, text) in enumerate(license_texts.TEXTS):
        words = text.split()
        broken = [w if rng.random() > 0.04 or len(words) < 40 else "changed" for w in words]
        holder = broken[: len(broken) // 3] + (["Example", "Company", "Ltd"] if len(words) > 60 else []) + broken[len(broken) // 3 :]
        rows += [(2 * k, " ".join(rng.choices(fill, k=40) + words + rng.choices(fill, k=40))), (2 * k + 1, "/* " + "\n * ".join(holder) + " */")]
        want[2 * k] = label
    rows += [(500, license_texts.TEXTS[0][2][len(license_texts.TEXTS[0][2]) // 2 :]), (501, " ".join(fill * 50)), (502, "permission is hereby granted to enter")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in want.items():
        assert label in got[k]["labels"].split(","), (label, got[k])
    assert sum(want[2 * (k // 2)] in got[k]["labels"].split(",") for k in range(1, 2 * len(license_texts.TEXTS), 2)) >= 0.85 * len(license_texts.TEXTS)
    assert [got[k]["labels"] for k in (500, 501, 502)] == [""] * 3


def test_alignments_against_brute_force(monkeypatch):
    """(text, template, shift) of the postings equal those of loops over all pairs of places, for several texts at once."""
    monkeypatch.setattr(licenses, "RAREST", 7)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)]
    index = licenses.Index([("a", (t.split()[0],), t) for t in (" ".join(rng.choices(vocabulary, k=9)) for _ in range(6))])
    texts = [licenses.hashes(" ".join(rng.choices([*vocabulary, "other", "more"], k=25))) for _ in range(30)] + [licenses.hashes("")]
    votes, doc, places, terms = {}, [], [], []
    for d, words in enumerate(texts):
        term = index.terms(words).tolist()
        rarest = sorted({t for t in term if t >= 0}, key=lambda t: (-index.idf[t], t))[:7]
        for k, t in enumerate(term):
            if t >= 0:
                doc, places, terms = [*doc, d], [*places, k], [*terms, t]
                for n, own in enumerate(index.words if t in rarest else ()):
                    for p in np.flatnonzero(own == words[k]).tolist():
                        votes.setdefault((d, n, k - p), set()).add(t)
    got = list(zip(*(x.tolist() for x in index.alignments(*(np.array(x, np.int64) for x in (doc, places, terms)))), strict=True))
    assert sorted(got) == sorted(x for x, v in votes.items() if len(v) >= licenses.VOTES) and got


VALUES = ["4111111111111111", "5500-0000-0000-0004", "+1 (017) 555-7713", "und.34@mail7.example.com", "235.58.234.215", "2024-02-29", "12/31/1999", "31.12.1999", "123-45-6789", "DE89370400440532013000"]


def test_pseudonyms(spark):
    texts = [" then ".join(VALUES), "again " + "; ".join(VALUES), "4111111111111112 300.1.1.1 2024-02-30 x4111111111111111 000-12-3456", None, "", "no value"]
    got = [r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    new = [p["value"] for p in got[0]["pii"]]
    assert got[0]["n_pii"] == len(VALUES) and [p["value"] for p in got[1]["pii"]] == new
    assert got[0]["text"] == " then ".join(new) and got[1]["text"] == "again " + "; ".join(new)
    assert [got[k]["text"] for k in (2, 3, 4, 5)] == [texts[2], "", "", "no value"]
    for old, value in zip(VALUES, new, strict=True):
        assert old != value and re.sub("[a-z]", "a", re.sub("[0-9]", "0", value.split("@")[0])) == re.sub("[a-z]", "a", re.sub("[0-9]", "0", old.split("@")[0])) or "." in old or "DE" in old
    again = [[(p["kind"]) for p in r["pii"]] for r in pii.pseudonymise(spark.createDataFrame([(0, got[0]["text"])], "doc_id long, text string"), "k").collect()][0]
    assert again == [p["kind"] for p in got[0]["pii"]]  # pseudonyms are valid values of their kinds
    other = pii.pseudonymise(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"), "other").first()
    assert other["text"] != got[0]["text"]


@pytest.mark.parametrize("size", [1, 2, 3])
def test_feistel_is_a_permutation(spark, size):
    df = spark.range(10**size).selectExpr(f"lpad(cast(id AS string), {size}, '0') AS t")
    out = [r[0] for r in df.select(pii.feistel(df["t"], "key", "x")).collect()]
    assert len(set(out)) == 10**size and all(len(x) == size and x.isdigit() for x in out)


def test_days_are_permuted(spark):
    """Each block's days onto themselves: an inner block and the two at the ends of the calendar."""
    ends = [(first, first + left * right) for first, left, right in (pii.EARLY, pii.LATE)]
    for lo, hi in [(0, pii.DOMAIN_DAYS), *ends]:
        df = spark.range(lo, hi).selectExpr("cast(id AS int) AS d")
        assert {r[0] for r in df.select(pii.permuted_day(df["d"], "key")).collect()} == set(range(lo, hi))
    assert ends[0][1] % pii.DOMAIN_DAYS == 0 and pii.LATE[0] % pii.DOMAIN_DAYS == 0
    assert (datetime.date(1, 1, 1) - datetime.date(1900, 1, 1)).days == ends[0][0] and (datetime.date(9999, 12, 31) - datetime.date(1900, 1, 1)).days == ends[1][1] - 1


def masked(text):
    return re.sub("[0-9]", "0", text)


def test_neighbours_stay_apart(spark):
    """Values beside other numbers are found one by one, and dates at the ends of the calendar stay dates."""
    texts = {
        "4111 1111 1111 1111 123": ["card"], "order 7 4111111111111111": ["card"], "4111111111111111 12/26": ["card"], "555-123-4567 2024-01-05": ["phone", "date"], "555-123-4567 555-987-6543": ["phone", "phone"],
        "+49 30 1234567 2024-01-05": ["phone", "date"], "3782-822463-10005": ["card"], "0001-01-01 9999-12-31 9896-02-29 0050-06-01": ["date"] * 4, "6304 1000 0000 0000 009": ["card"],
    }
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    for r in rows:
        text = list(texts)[r["doc_id"]]
        assert [p["kind"] for p in r["pii"]] == texts[text], text
        assert r["text"] != text and masked(r["text"]) == masked(text)
        for day in re.findall(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r["text"]):
            datetime.date.fromisoformat(day)
    assert rows[0]["text"].endswith(" 123") and rows[1]["text"].startswith("order 7 ")
    again = pii.pseudonymise(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string"), "k").collect()
    assert [[p["kind"] for p in r["pii"]] for r in again] == [[p["kind"] for p in r["pii"]] for r in rows]


def brute_pseudonyms(text, pseudonym):
    """A walk from place to place: at each, the first kind in order whose pattern matches there; its value goes through the operator alone."""
    out, at = [], 0
    patterns = {k: re.compile(p.replace("++", "+"), re.ASCII) for k, p in pii.PATTERNS.items()}
    while at < len(text):
        m = next((x for k in pii.ORDER if (x := patterns[k].match(text, at))), None)
        out.append(pseudonym(m[0]) if m else text[at])
        at = m.end() if m else at + 1
    return "".join(out)


def test_pseudonyms_against_a_walk(spark):
    """Whole texts equal a walk that replaces each value by what the operator makes of it alone."""
    rng = random.Random(4)
    fill = ["and", "x", "12", "7-8", "a4", ":", "\n", "é", "(", "300.1.1.1", "4111111111111112", "2024-02-30"]
    texts = ["".join(rng.choice([v + " ", v + "; ", v + "\n"]) for v in rng.choices(VALUES + fill, k=30)) for _ in range(12)]
    values = sorted({w for t in texts for w in [t[m.start() : m.end()] for p in pii.PATTERNS.values() for m in re.finditer(p.replace("++", "+"), t, re.ASCII)]})
    alone = {values[r["doc_id"]]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string"), "k").collect()}
    for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect():
        assert r["text"] == brute_pseudonyms(texts[r["doc_id"]], alone.__getitem__)


def test_key_stays_out_of_plans(spark, capsys):
    pii.pseudonymise(spark.createDataFrame([(0, "4111111111111111")], "doc_id long, text string"), "my-own-secret").explain(True)
    plan = capsys.readouterr().out
    assert "my-own-secret" not in plan and hashlib.sha256(b"my-own-secret").hexdigest()[:16] not in plan


def test_scans_odd(odd, empty):
    n = odd.count()
    for scan in (secrets.scan_secrets, licenses.scan_licenses, lambda d: pii.pseudonymise(d, "k")):
        assert len(scan(odd).collect()) == n and scan(empty).collect() == []
