"""License scans by a positional index of rare license words.

Templates (license texts, file headers, names) are indexed by word: word -> (template, position). Of the license words that a file holds, the RAREST with the highest IDF are looked up; their postings meet where the file's position minus the template's is one shift for VOTES words or more. These alignments are checked word by word, and the template's key phrases must stand there in a row.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, text_buffer
from .kernels import LOWER, doc_words, span_hashes, word_spans
from .license_texts import TEMPLATES

#: Phrases that are licenses by themselves (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Share of a template's IDF weight that makes a match; words at one shift that make an alignment; words of a file that are looked up.
SHARE, VOTES, RAREST = 0.6, 2, 128
#: Words in more than one of COMMON templates are not indexed, but for the LEAST rarest of each template. SPAN: beyond the words of a text.
COMMON, LEAST, SPAN = 8, 4, 1 << 32

#: Digits, small letters and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def hashes(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end = word_spans(data, np.array([0, len(data)]), WORD)
    return span_hashes(data, start, end)


class Index:
    """Postings of the rare template words with their IDF over templates, and the places of key phrases."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.words = [hashes(t[2]) for t in templates]
        self.keys = [[place(words, hashes(k)) for k in t[1]] for t, words in zip(templates, self.words, strict=True)]
        size = [len(w) for w in self.words]
        every, of = np.concatenate(self.words), np.repeat(np.arange(len(size)), size)
        at = np.concatenate([np.arange(n) for n in size])
        known, term = np.unique(every, return_inverse=True)
        files = np.bincount(np.unique(term * len(size) + of) // len(size), minlength=len(known))
        idf = np.log(1 + len(size) / files)
        self.weight = [idf[np.searchsorted(known, w)] for w in self.words]
        # Words of few templates are indexed, and of every template its LEAST rarest ones at least.
        rare = files <= max(1, len(size) // COMMON)
        for words in self.words:
            own = np.unique(np.searchsorted(known, words))
            rare[own[np.argsort(-idf[own], kind="stable")[:LEAST]]] = True
        self.known, self.idf = known[rare], idf[rare]
        number = np.cumsum(rare) - 1
        order = np.flatnonzero(rare[term])
        order = order[np.argsort(term[order], kind="stable")]
        self.post_template, self.post_at = of[order], at[order]
        self.post_count = np.bincount(number[term[order]], minlength=len(self.known))
        self.post_first = np.cumsum(self.post_count) - self.post_count

    def terms(self, words: np.ndarray) -> np.ndarray:
        """The number of each word among the indexed ones, -1 for others."""
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, at, -1)

    def alignments(self, doc: np.ndarray, places: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, template, shift) on which VOTES different words agree, from the indexed words of several texts: their text, place in it and number. In each text the RAREST with the highest IDF are looked up."""
        n_terms, n_templates = len(self.known), len(self.words)
        pair = doc * n_terms + term
        held = np.unique(pair)
        order = np.lexsort((held % n_terms, -self.idf[held % n_terms], held // n_terms))
        own = held[order] // n_terms
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        looked = np.isin(pair, held[order[rank < RAREST]])
        doc, places, term = doc[looked], places[looked], term[looked]
        n = self.post_count[term]
        posting = np.repeat(self.post_first[term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = (np.repeat(doc, n) * n_templates + self.post_template[posting]) * SPAN + np.repeat(places, n) - self.post_at[posting] + SPAN // 2
        agreed, votes = np.unique(np.unique(place * n_terms + np.repeat(term, n)) // n_terms, return_counts=True)
        agreed = agreed[votes >= VOTES]
        where = agreed // SPAN
        return where // n_templates, where % n_templates, agreed % SPAN - SPAN // 2

    def match(self, words: np.ndarray, shifts: dict[int, list[int]]) -> dict[str, float]:
        """Label -> best share of a template's weight, for one text's word hashes and the shifts of each template in it.

        Words that a file inserts or leaves out move the shift: alignments up to the template's length from its best one count together.
        """
        found: dict[str, float] = {}
        for k, own in shifts.items():
            size, weight = len(self.words[k]), self.weight[k]
            agree = np.zeros((len(own), size), bool)
            for row, shift in zip(agree, own, strict=True):
                lo, hi = max(0, -shift), min(size, len(words) - shift)
                row[lo:hi] = words[shift + lo : shift + hi] == self.words[k][lo:hi]
            best = int(np.argmax(agree @ weight))
            near = agree[np.abs(np.array(own) - own[best]) <= size]
            share = float(weight[near.any(0)].sum() / weight.sum())
            if share >= SHARE and all(near[:, at : at + n].all(1).any() for at, n in self.keys[k]):
                found[self.labels[k]] = max(found.get(self.labels[k], 0.0), min(share, 1.0))
        return found


def place(words: np.ndarray, phrase: np.ndarray) -> tuple[int, int]:
    """(first place, size) of a phrase among words."""
    n = len(phrase)
    at = next((p for p in range(len(words) - n + 1) if (words[p : p + n] == phrase).all()), None)
    if at is None:
        raise ValueError("a template does not hold its key phrase")
    return at, n


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A phrase place counts wherever its words stand in a row; first_word and last_word are the smallest and largest starts. score is 1 where a base phrase stands, else the best template's share (0: none). Null and empty texts have no words. Texts are scanned whole. Repeated rows are scanned each; a null id stays null. Other columns are not looked at. Empty input: empty output.
    """
    index = Index(templates)
    phrases = [(hashes(p), label) for p, label in BASE]

    @F.arrow_udf("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for s in slices(texts):
            rows += scan_slice(texts.slice(*s), index, phrases)
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return documents(docs).select("doc_id", scan("text").alias("s")).select("doc_id", "s.*")


def scan_slice(texts: pa.Array, index: Index, phrases: list[tuple[np.ndarray, str]]) -> list[tuple]:
    data, off = text_buffer(texts)
    _, _, _, words, of = doc_words(data, off, WORD)
    n = len(texts)
    at = np.searchsorted(of, np.arange(n + 1))
    places: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for phrase, label in phrases:
        last = len(phrase) - 1
        hit = np.flatnonzero(words[last:] == phrase[last])
        for k in range(last):
            hit = hit[words[hit + k] == phrase[k]]
        hit = hit[of[hit] == of[hit + last]] if len(hit) else hit
        for h in hit.tolist():
            places[int(of[h])].append((h - int(at[of[h]]), label))
    term = index.terms(words)
    held = np.flatnonzero(term >= 0)
    shifts: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for d, template, shift in zip(*(x.tolist() for x in index.alignments(of[held], held - at[of[held]], term[held])), strict=True):
        shifts[d][template].append(shift)
    out = []
    for d in range(n):
        found = index.match(words[at[d] : at[d + 1]], shifts[d]) if d in shifts else {}
        starts = [p for p, _ in places.get(d, ())]
        base = sorted({label for _, label in places.get(d, ())})
        score = 1.0 if base else max(found.values(), default=0.0)
        out.append((int(at[d + 1] - at[d]), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *found})), min(score, 1.0)))
    return out
