"""Secret scans by grammar inference.

For each kind of labelled credential a prefix tree is built, and its statistically compatible states are merged (Hoeffding bound on stops, transitions and the characters read, as in ALERGIA) into a probabilistic automaton. Separators that all examples of a kind hold equally often are symbols of their own; any other character is one symbol, whose class of characters each state emits with its own frequency. So hundreds of examples run through each state of a fixed-length format, and its states stay apart. States are typed by the separators still to come, and merge only within a type.

Every candidate in a text is scored by its likelihood under each automaton against a model of ordinary tokens. Spans of fixed patterns are found beside them and always stay.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import os.path
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

# Fixed patterns of the scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Runs in which candidates begin and end. A candidate is bounded by the run's ends or by characters that are neither letters nor digits.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

#: Base64 of this length is data, not a key.
DATA_LEAST = 128
DATA = re.compile(rf"[A-Za-z0-9+/]{{{DATA_LEAST},}}")

HEX_LOW, HEX_UP = "0123456789abcdef", "0123456789ABCDEF"
LOW, UP, NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM = LOW + UP + NUM
#: Credential formats that labelled examples are made of (fixed values): kind, then parts that are text or (alphabet, lengths).
FORMATS = (
    ("github", "ghp_", (ALNUM, (36,))),
    ("gitlab", "glpat-", (ALNUM + "_-", (20,))),
    ("google", "AIza", (ALNUM + "_-", (35,))),
    ("npm", "npm_", (ALNUM, (36,))),
    ("slack", "xoxb-", (NUM, (11, 12, 13)), "-", (NUM, (11, 12, 13)), "-", (ALNUM, (24,))),
    ("stripe", "sk_live_", (ALNUM, (24,))),
    ("hexkey", (HEX_LOW, (32, 40, 64))),
    ("hexkey", (HEX_UP, (32, 40, 64))),
    ("random", (ALNUM, (32, 40, 64))),
    ("random", (ALNUM + "+/", (40,))),
)
#: Bytes of keys that are written in base64, and of the parts of a signed web token.
BASE64_BYTES, CLAIM_BYTES, SIGNATURE_BYTES = (16, 20, 32, 64), (30, 120), (32, 64)
EXAMPLES, SEED, ALPHA, MARGIN = 300, 7, 0.05, 12.0


def labelled(seed: int = SEED, examples: int = EXAMPLES) -> list[tuple[str, str]]:
    """Labelled credentials: (kind, value), made from FORMATS, and keys in base64 and signed web tokens."""
    rng = random.Random(seed)

    def part(p) -> str:
        return p if isinstance(p, str) else "".join(rng.choice(p[0]) for _ in range(rng.choice(p[1])))

    def url(data: bytes) -> str:
        return base64.urlsafe_b64encode(data).decode().rstrip("=")

    out = [(kind, "".join(map(part, parts))) for kind, *parts in FORMATS for _ in range(examples)]
    out += [("base64", base64.b64encode(rng.randbytes(n)).decode()) for n in BASE64_BYTES for _ in range(examples)]
    for _ in range(examples):
        head = {"alg": rng.choice(("HS256", "RS256", "ES256")), "typ": "JWT"} | ({"kid": rng.randbytes(4).hex()} if rng.random() < 0.3 else {})
        claims = {"sub": str(rng.randrange(10**9)), "iat": rng.randrange(10**9, 2 * 10**9)} | ({"name": "".join(rng.choice(LOW) for _ in range(rng.randint(1, CLAIM_BYTES[1] - CLAIM_BYTES[0])))} if rng.random() < 0.8 else {})
        out.append(("webtoken", ".".join((*(url(json.dumps(x, separators=(",", ":")).encode()) for x in (head, claims)), url(rng.randbytes(rng.choice(SIGNATURE_BYTES)))))))
    return out


#: Prose in four languages from which letter pairs of ordinary tokens are counted.
PROSE = """when the water rose over the lower fields the people of the village carried what they could up to the old church on the hill and waited there through the night for the morning boats which came with bread blankets and news from the other side of the river
the government announced that every school would receive additional support for teaching science and mathematics while local councils remained responsible for buildings transport and meals throughout the following year
als das wasser über die unteren felder stieg trugen die leute des dorfes was sie konnten hinauf zur alten kirche auf dem hügel und warteten dort die ganze nacht auf die boote die am morgen mit brot decken und nachrichten von der anderen seite des flusses kamen
quand l eau monta sur les champs du bas les gens du village portèrent ce qu ils pouvaient jusqu à la vieille église sur la colline et attendirent là toute la nuit les bateaux du matin qui venaient avec du pain des couvertures et des nouvelles de l autre rive
cuando el agua subió sobre los campos bajos la gente del pueblo llevó lo que pudo hasta la vieja iglesia de la colina y esperó allí toda la noche los barcos de la mañana que venían con pan mantas y noticias de la otra orilla del río"""
WORDS = re.findall("[a-z]+", PROSE)


def ordinary(seed: int = SEED, examples: int = 200) -> list[str]:
    """Ordinary long tokens: numbers, names in several styles, paths, hosts, dates, versions, identifiers."""
    rng = random.Random(seed)

    def words(least: int = 2, most: int = 5) -> list[str]:
        return [rng.choice(WORDS) for _ in range(rng.randint(least, most))]

    def digits(least: int, most: int) -> str:
        return "".join(rng.choice(NUM) for _ in range(rng.randint(least, most)))

    out = []
    for _ in range(examples):
        out += [digits(8, 30), "_".join(words()) + digits(0, 3), "-".join(words()) + "-" + digits(1, 4), "/".join(words()) + "/" + digits(0, 2), ".".join(words(2, 4)) + ".com", "".join(words(3, 6))]
        out += ["".join(w.capitalize() for w in words()) + digits(0, 2), words(1, 1)[0] + "".join(w.capitalize() for w in words()), "_".join(w.upper() for w in words()) + digits(0, 3), "".join(words(2, 4)).upper()]
        out += [f"20{digits(2, 2)}-{digits(2, 2)}-{digits(2, 2)}-{words(1, 1)[0]}-{digits(1, 9)}", f"{words(1, 1)[0]}-{digits(1, 2)}.{digits(1, 2)}.{digits(1, 2)}", words(1, 1)[0].capitalize() + "".join(words(2, 5)) + "."]
        out += ["-".join("".join(rng.choice(HEX_LOW) for _ in range(n)) for n in (8, 4, 4, 4, 12)), "=".join(words(2, 3)), "+".join(words(2, 4)), "x" * rng.randint(16, 30), "=" * 16 + "-" * 8]
    return out


def char_class(c: str) -> str:
    """Digits, the letters of hex numbers and the others in either case; any other character stands for itself."""
    if c in NUM:
        return "0"
    if c in LOW:
        return "f" if c < "g" else "z"
    if c in UP:
        return "F" if c < "G" else "Z"
    return c


CLASSES = {c: char_class(c) for c in map(chr, range(128))}
SIZES = {"0": 10, "f": 6, "z": 20, "F": 6, "Z": 20}
#: The symbol of a character that is no separator; separators in the order in which they are looked for.
BODY, SEPARATORS = "w", "+/_.=-"


class Automaton:
    """A probabilistic automaton of values after a fixed prefix."""

    def __init__(self, values: Iterable[str], alpha: float = ALPHA):
        values = list(values)
        self.prefix = os.path.commonprefix(values)
        rest = [v[len(self.prefix) :] for v in values]
        # "=" fills up at the end only, and is a separator in any number.
        self.separators = {c for c in SEPARATORS if c == "=" or len({v.count(c) for v in rest}) == 1 and c in rest[0]}
        self.alphabet = sorted({CLASSES[c] for v in rest for c in v if c not in self.separators})
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = []
        self.count: list[Counter] = []  # by symbol
        self.read: list[Counter] = []  # by class of the characters of BODY
        self.stop: list[int] = []
        self.ahead: list[set[str]] = []  # separators still to come
        self.state()
        for v in rest:
            self.add(v)
        self.tree = len(self.next)
        self.red = self.merge()
        self.table = {s: self.logarithms(s) for s in self.red}
        self.least = len(self.prefix) + min(map(len, rest))
        self.next, self.count, self.read, self.stop, self.ahead = [], [], [], [], []  # the table is all that scoring needs

    def symbol(self, c: str) -> str:
        return c if c in self.separators else BODY

    def state(self) -> int:
        for column, empty in ((self.next, {}), (self.count, Counter()), (self.read, Counter()), (self.stop, 0), (self.ahead, set())):
            column.append(empty)
        return len(self.next) - 1

    def add(self, value: str) -> None:
        at, left = 0, "".join(c for c in value if c in self.separators)
        self.ahead[0].add(left)
        for c in value:
            s = self.symbol(c)
            self.count[at][s] += 1
            if s == BODY:
                self.read[at][CLASSES[c]] += 1
            else:
                left = left[1:]
            if s not in self.next[at]:
                self.next[at][s] = self.state()
            at = self.next[at][s]
            self.ahead[at].add(left)
        self.stop[at] += 1

    def visits(self, s: int) -> int:
        return self.stop[s] + self.count[s].total()

    def differ(self, f: int, n: int, g: int, m: int) -> bool:
        return bool(n and m) and abs(f / n - g / m) > self.bound * (n**-0.5 + m**-0.5)

    def compatible(self, p: int, q: int) -> bool:
        """Do p and the tree under q agree statistically, here and after every common symbol?"""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if self.ahead[p] != self.ahead[q]:
                return False
            n, m = self.visits(p), self.visits(q)
            if self.bound * (n**-0.5 + m**-0.5) < 1:  # else no two shares differ by more than the bound
                if self.differ(self.stop[p], n, self.stop[q], m):
                    return False
                if any(self.differ(self.count[p][c], n, self.count[q][c], m) for c in self.count[p].keys() | self.count[q].keys()):
                    return False
                n, m = self.count[p][BODY], self.count[q][BODY]
                if any(self.differ(self.read[p][c], n, self.read[q][c], m) for c in self.read[p].keys() | self.read[q].keys()):
                    return False
            todo += [(self.next[p][c], self.next[q][c]) for c in self.next[p].keys() & self.next[q].keys()]
        return True

    def fold(self, p: int, q: int) -> None:
        """The tree under q becomes part of p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.stop[p] += self.stop[q]
            self.count[p].update(self.count[q])
            self.read[p].update(self.read[q])
            self.ahead[p] |= self.ahead[q]
            for c, t in self.next[q].items():
                if c in self.next[p]:
                    todo.append((self.next[p][c], t))
                else:
                    self.next[p][c] = t

    def merge(self) -> list[int]:
        """Red states are final; blue ones, their successors in the tree, merge into the first compatible red state or turn red, the most visited first."""
        red, final = [0], {0}
        while blue := [(s, c) for s in red for c, t in self.next[s].items() if t not in final]:
            s, c = max(blue, key=lambda b: (self.visits(self.next[b[0]][b[1]]), -b[0], b[1]))
            t = self.next[s][c]
            home = next((r for r in red if self.compatible(r, t)), None)
            if home is None:
                red.append(t)
                final.add(t)
            else:
                self.next[s][c] = home
                self.fold(home, t)
        return red

    def logarithms(self, s: int) -> tuple[dict[str, tuple[float, int]], float | None]:
        """(class of a character -> (log-probability of one character of it, next state), log-probability of a stop or None).

        Classes of the kind's alphabet that a state has not read get half a case. A stop or a separator that no example has there is no step at all: it would be another format.
        """
        n = self.visits(s)
        steps = {c: (math.log(k / n), self.next[s][c]) for c, k in self.count[s].items() if c != BODY}
        if body := self.count[s][BODY]:
            for c in self.alphabet:
                p = (self.read[s][c] + 0.5) / (body + 0.5 * len(self.alphabet)) / SIZES.get(c, 1)
                steps.setdefault(c, (math.log(body / n * p), self.next[s][BODY]))
        return steps, math.log(self.stop[s] / n) if self.stop[s] else None

    def ends(self, coded: str, start: int) -> Iterable[tuple[int, float]]:
        """(end, log-likelihood) of the values that begin after the prefix at a place of a run of classes."""
        at, total = 0, 0.0
        table = self.table
        for k in range(start, len(coded) + 1):
            steps, stop = table[at]
            if stop is not None:
                yield k, total + stop
            if k == len(coded) or (step := steps.get(coded[k])) is None:
                return
            total += step[0]
            at = step[1]


class Ordinary:
    """Pairs of classes, and of letters, in ordinary tokens; one added to each count."""

    def __init__(self, values: Iterable[str]):
        kinds, letters = defaultdict(Counter), defaultdict(Counter)
        for v in values:
            coded = self.coarse(v)
            for a, b in zip("^" + coded, coded + "$", strict=True):
                kinds[a][b] += 1
        for w in WORDS:
            for a, b in zip("^" + w[:-1], w, strict=True):
                letters[a][b] += 1
        symbols = ["0", "f", "F", "$", *SEPARATORS]
        kind = {(a, b): math.log((kinds[a][b] + 1) / (kinds[a].total() + len(symbols))) for a in ["^", *symbols] for b in symbols}
        letter = {(a, b): math.log((letters[a][b] + 1) / (letters[a].total() + 26)) for a in "^" + LOW for b in LOW}
        every = ["^", *ALNUM, *SEPARATORS]
        self.log = {}
        for a in every:
            x = a if a == "^" else self.coarse(a)
            for b in every[1:]:
                y = self.coarse(b)
                within = math.log(0.1) if y == "0" else letter[a.lower() if a.isalpha() else "^", b.lower()] if y in "fF" else 0.0
                self.log[a, b] = kind[x, y] + within
            self.log[a, "$"] = kind[x, "$"]

    @staticmethod
    def coarse(text: str) -> str:
        return "".join("0" if c.isdigit() else "f" if c.islower() else "F" if c.isupper() else c for c in text)

    def sums(self, run: str) -> list[float]:
        """Log-likelihood of each step in a run, added up; the first character's is left out."""
        return [0.0, 0.0, *accumulate(map(self.log.__getitem__, zip(run, run[1:], strict=False)))]

    def score(self, run: str, sums: list[float], start: int, end: int) -> float:
        return self.log["^", run[start]] + sums[end] - sums[start + 1] + self.log[run[end - 1], "$"]


def form(value: str) -> str:
    """Which of small letters, capitals and +/ a value holds: values of one kind that differ in it are formats of their own."""
    return "".join(c for c, has in (("a", any(map(str.islower, value))), ("A", any(map(str.isupper, value))), ("+", "+" in value or "/" in value)) if has)


class Scanner:
    """Spans of secrets in a text: fixed patterns, and candidates that an automaton explains better than ordinary text by `margin` nats."""

    def __init__(self, credentials: list[tuple[str, str]] | None = None, margin: float = MARGIN):
        by_kind: dict[tuple[str, str], list[str]] = defaultdict(list)
        for kind, value in credentials if credentials is not None else labelled():
            by_kind[kind, form(value)].append(value)
        self.automata = [(kind, Automaton(values)) for (kind, _), values in sorted(by_kind.items())]
        self.ordinary = Ordinary(ordinary())
        self.margin = margin

    def data(self, run: str, sums: list[float]) -> list[tuple[int, int]]:
        """Stretches of a run that are base64 data, longer than any key: likelier even letters than ordinary text."""
        spans = [m.span() for m in DATA.finditer(run)] if len(run) >= DATA_LEAST else []
        return [(s, e) for s, e in spans if -math.log(64) * (e - s) > self.ordinary.score(run, sums, s, e)]

    def found(self, run: str) -> list[tuple[int, int, str]]:
        """The candidates of a run that are credentials; of those that overlap, the one with the greatest likelihood ratio. In base64 data only kinds with a prefix are looked for: its pieces have the form of keys by chance."""
        bounds = [k for k in range(len(run) + 1) if k in (0, len(run)) or not (run[k - 1].isalnum() and run[k].isalnum())]
        inner = set(bounds)
        coded, sums, hits = "".join(map(CLASSES.__getitem__, run)), self.ordinary.sums(run), []
        data = self.data(run, sums)
        for start in bounds:
            held = any(s <= start < e for s, e in data)
            for kind, a in self.automata:
                if held and not a.prefix:
                    continue
                if len(run) - start >= a.least and run.startswith(a.prefix, start):
                    for end, log in a.ends(coded, start + len(a.prefix)):
                        if end in inner and end > start and (more := log - self.ordinary.score(run, sums, start, end)) >= self.margin:
                            hits.append((-more, start, end, kind))
        out: list[tuple[int, int, str]] = []
        for _, start, end, kind in sorted(hits):
            if all(end <= s or e <= start for s, e, _ in out):
                out.append((start, end, kind))
        return sorted(out)

    def kind_of(self, token: str) -> str | None:
        """The kind of a token that is a credential as a whole."""
        return next((kind for start, end, kind in self.found(token) if (start, end) == (0, len(token))), None) if RUN.fullmatch(token) else None

    def scan(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(fixed spans, spans that the automata add): start, end, kind in code points, ends exclusive. Added spans touch no fixed one."""
        base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
        base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        base.sort(key=lambda s: (s[0], ORDER[s[2]]))
        more = []
        for m in RUN.finditer(text):
            for s, e, kind in self.found(m[0]):
                s, e = s + m.start(), e + m.start()
                if not any(x < e and s < y for x, y, _ in base):
                    more.append((s, e, kind))
        return base, more


ORDER = {"assign": 0, "access": 1, "hex": 2}


def joined(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, credentials: list[tuple[str, str]] | None = None, margin: float = MARGIN) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, found (array of start, end, kind).

    Null and empty texts have no spans. Texts are scanned whole. Repeated rows are scanned each; a null id stays null. Other columns are not looked at. Empty input: empty output.
    """
    scanner = Scanner(credentials, margin)
    kinds = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, found array<struct<start:long,end:long,kind:string>>"

    @F.arrow_udf(f"struct<{kinds.replace(' long', ':long').replace(' string', ':string').replace(' array', ':array')}>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            base, more = scanner.scan(text)
            n = [sum(k == kind for _, _, k in base) for kind in ORDER]
            every = sorted(base + more, key=lambda s: (s[0], ORDER.get(s[2], 9), s[2]))
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(more), [{"start": s, "end": e, "kind": k} for s, e, k in every]))
        names = [k.split()[0] for k in kinds.split(", ")]
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return documents(docs).select("doc_id", scan("text").alias("s")).select("doc_id", "s.*")
