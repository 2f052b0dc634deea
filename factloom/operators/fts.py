"""Full-text search with trigram semantics: queries are parsed on the driver, evaluated as substring tests and ranked by BM25."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()*,])|([A-Za-z0-9_\x80-\U0010ffff]+)|(\S))')


class QueryError(ValueError):
    """The text is no query."""


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    left: object
    right: object


def too_short(text: str) -> bool:
    """Fewer than three bytes that are neither quotes nor white space: nothing can be looked up."""
    return len(re.sub(r'["\s]', "", text).encode()) < 3


def parse(text: str):
    """AND, OR, NOT (in capitals), implicit AND, "phrases", prefix*, NEAR(a b, n), parentheses. NOT binds tighter than AND, AND than OR."""
    tokens: list[tuple[str, str]] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if m[4]:
            raise QueryError(f"unexpected {m[4]!r}")
        tokens.append(("phrase", m[1].replace('""', '"')) if m[1] is not None else ("sign", m[2]) if m[2] else ("word", m[3]))
        at = m.end()
    place = 0

    def peek() -> tuple[str, str] | None:
        return tokens[place] if place < len(tokens) else None

    def take(*want: str) -> str:
        nonlocal place
        t = peek()
        if t is None or want and t[1] not in want:
            raise QueryError("the query breaks off" if t is None else f"unexpected {t[1]!r}")
        place += 1
        return t[1]

    def atom():
        kind, value = peek() or (None, "")
        if kind == "sign" and value == "(":
            take("(")
            inner = either()
            take(")")
            return inner
        if kind == "word" and value == "NEAR" and place + 1 < len(tokens) and tokens[place + 1] == ("sign", "("):
            take(), take("(")
            phrases, distance = [], 10
            while (t := peek()) and t[1] not in (",", ")"):
                phrases.append(Phrase(take()))
            if take(",", ")") == ",":
                number = take()
                if not number.isdigit():
                    raise QueryError("NEAR needs a number")
                distance = int(number)
                take(")")
            return Near(tuple(phrases), distance)
        if kind not in ("word", "phrase") or kind == "word" and value in ("AND", "OR", "NOT"):
            raise QueryError("a phrase is missing")
        take()
        if peek() == ("sign", "*"):
            take("*")
        return Phrase(value)

    def without():
        left = atom()
        while peek() == ("word", "NOT"):
            take("NOT")
            left = Without(left, atom())
        return left

    def both():
        left = implicit()
        while peek() == ("word", "AND"):
            take("AND")
            left = Both(left, implicit())
        return left

    def implicit():
        left = without()
        while (t := peek()) and t not in (("word", "AND"), ("word", "OR"), ("word", "NOT"), ("sign", ")"), ("sign", ",")):
            right = without()
            # A phrase under three characters asks nothing beside others.
            if isinstance(right, Phrase) and len(right.text) < 3:
                continue
            left = right if isinstance(left, Phrase) and len(left.text) < 3 else Both(left, right)
        return left

    def either():
        left = both()
        while peek() == ("word", "OR"):
            take("OR")
            left = Either(left, both())
        return left

    out = either()
    if peek():
        raise QueryError(f"unexpected {peek()[1]!r}")
    return out


def phrases(query) -> list[str]:
    """The phrases that rank: all but those behind NOT."""
    if isinstance(query, Phrase):
        return [query.text] if len(query.text) >= 3 else []
    if isinstance(query, Near):
        return [p.text for p in query.phrases if len(p.text) >= 3]
    return phrases(query.left) + ([] if isinstance(query, Without) else phrases(query.right))


def condition(query, text: Column) -> Column:
    """Does a folded text satisfy the query? A phrase under three characters is nowhere."""
    if isinstance(query, Phrase):
        return text.contains(query.text.lower()) if len(query.text) >= 3 else F.lit(False)
    if isinstance(query, Near):
        found = F.lit(True)
        for p in query.phrases:
            found &= condition(p, text)
        if len(query.phrases) == 2:
            a, b = (re.escape(p.text.lower()) for p in query.phrases)
            gap = f"(?s).{{0,{query.distance + 2}}}"
            found &= text.rlike(f"{a}{gap}{b}|{b}{gap}{a}")
        return found
    left, right = condition(query.left, text), condition(query.right, text)
    return left & right if isinstance(query, Both) else left | right if isinstance(query, Either) else left & ~right


def occurrences(text: Column, phrase: str) -> Column:
    """How often a phrase stands in a text, overlapping places included."""
    return F.regexp_count(text, F.lit(f"(?={re.escape(phrase.lower())})"))


def find(section: DataFrame, text: str, key: str = "id", column: str = "text") -> DataFrame:
    """Sections that satisfy a query: key, rank (BM25, smaller is better), snippet; two passes over the text, the first for the corpus counts."""
    query = parse(text)
    terms = phrases(query)
    folded = F.lower(F.col(column))
    size = F.greatest(F.length(column) - 2, F.lit(0))
    counts = section.agg(F.count("*").alias("n"), F.avg(size).alias("mean"), *[F.count_if(folded.contains(t.lower())).alias(f"n{k}") for k, t in enumerate(terms)])
    hits = section.where(condition(query, folded)).join(F.broadcast(counts), F.lit(True))
    rank = F.lit(0.0)
    for k, t in enumerate(terms):
        idf = F.greatest(F.log((F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5)), F.lit(LEAST_IDF))
        f = occurrences(folded, t).cast("double")
        rank = rank - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.col("mean")))
    return hits.select(key, rank.alias("rank"), snippet(F.col(column), terms).alias("snippet"))


def snippet(text: Column, terms: list[str], width: int = 26) -> Column:
    """About `width` characters around the first phrase, which is marked."""
    if not terms:
        return F.lit("")
    at = F.instr(F.lower(text), terms[0].lower())
    n = len(terms[0])
    begin = F.greatest(at - (width - n) // 2, F.lit(1)) if n < width else at
    before = F.substring(text, begin, at - begin)
    word, after = F.substring(text, at, F.lit(n)), F.substring(text, at + n, F.greatest(F.lit(width - n) - (at - begin), F.lit(0)))
    dots = F.when(begin > 1, " ... ").otherwise(""), F.when(at + n + F.length(after) <= F.length(text), " ... ").otherwise("")
    return F.when(at > 0, F.concat(dots[0], before, F.lit(">>>"), word, F.lit("<<<"), after, dots[1])).otherwise("")


@F.arrow_udf(ArrayType(StringType()))
def grams(texts: pa.Array) -> pa.Array:
    """Each three characters in a row of a text, once; sorted code points, three to a number."""
    rows, none = [], np.zeros(0, np.uint64)
    for text in texts.cast(pa.large_binary()).to_pylist():
        c = np.frombuffer((text or b"").decode(errors="replace").encode("utf-32-le"), "<u4").astype(np.uint64)
        own = np.sort(c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)) if len(c) > 2 else none
        rows.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else none)
    every = np.concatenate([none, *rows])
    points = np.stack([every >> np.uint64(k) & np.uint64(0x1FFFFF) for k in (0, 21, 42)], 1).astype("<u4")
    size = 3 + sum((points >= least).sum(1) for least in (0x80, 0x800, 0x10000))
    at, data = np.append(0, np.cumsum(size)).astype(np.int32), points.tobytes().decode("utf-32-le").encode()
    values = pa.StringArray.from_buffers(len(every), pa.py_buffer(at), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rows])), pa.int32()), values)


def trigrams(section: DataFrame, key: str = "id", column: str = "text") -> DataFrame:
    """An inverted index: (gram, id), each gram of a folded text once, for tables that are searched often. The work grows with a text's length, not with its square."""
    return section.select(F.explode(grams(F.lower(column))).alias("gram"), F.col(key).alias("id"))


def candidates(index: DataFrame, *phrases: str) -> DataFrame:
    """Ids of texts with all trigrams of all phrases: a superset of those with the phrases. One pass over the index."""
    own = sorted({p.lower()[k : k + 3] for p in phrases for k in range(len(p.lower()) - 2)})
    return index.where(F.col("gram").isin(own)).groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(own)).select("id")
