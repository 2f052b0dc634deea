"""Near-duplicate detection by MinHash and a multi-index Hamming join.

1. Each text's shingle set (5 words) becomes a signature of CHUNKS x CHUNK symbols of 16 bits. Texts with one word sequence are one class.
2. Pigeonhole: two signatures that differ in at most DISTANCE = CHUNKS * 2 - 1 symbols have a chunk with one error at most. Each chunk's allowed error is enumerated by leaving out one symbol at a time, so each signature has CHUNKS * CHUNK keys, and all pairs up to DISTANCE share one.
3. Rows that share a key form a group, and so do, afterwards, rows that links between signatures up to DISTANCE apart connect. Links are found in groups of either kind in the same way, by signatures alone at first, by full shingle sets then. A group is dealt over blocks, each row once, with a few pivot rows of the group in all of them. Within a block rows meet the pivots first; then only rows outside the largest part meet the others. What still is outside a group's largest part after all links are joined meets, in a second round, the rows of that group's other parts. So a group of copies costs as much as it has rows, and no pair goes unseen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, saved, skew_join, slices, text_buffer
from .components import components, local_components
from .kernels import U, doc_words, mix, windows

WORDS, PERCENT = 5, 75
CHUNKS, CHUNK = 20, 4
#: Signature distance (of CHUNKS * CHUNK symbols) up to which rows are compared; the keys find all such pairs. At a similarity of exactly 0.75, one pair in 760,000 is further apart.
DISTANCE = CHUNKS * 2 - 1
#: Rows of a block of signatures; rows and bytes of a block of texts; rows of a group that all its blocks get.
BLOCK, TEXT_ROWS, TEXT_BYTES, PIVOTS = 1024, 256, 8 << 20, 4
#: Ids that may be broadcast, with group, block and digest (some 50 bytes each).
BROADCAST_IDS = 500_000

SIZE = CHUNKS * CHUNK
TIMES = mix(np.arange(1, SIZE + 1, dtype=U)) | U(1)
PLUS = mix(np.arange(1001, SIZE + 1001, dtype=U))
SIGNED = "doc_id long, digest binary, n_shingles long, size long, sig binary"


def signatures(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash symbols (texts x SIZE, 16 bits) of shingles dealt to texts that begin at `first` (no text is empty)."""
    out = np.empty((len(first), SIZE), np.uint16)
    for k in range(SIZE):
        out[:, k] = mix(np.minimum.reduceat(shingles * TIMES[k] + PLUS[k], first)) >> U(48)
    return out


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and their text bounds, shingle hashes and their text bounds."""
    data, off = text_buffer(texts)
    n = len(texts)
    _, _, _, words, of = doc_words(data, off)
    shingles, doc, _ = windows(words, of, n, WORDS)
    at = np.arange(n + 1)
    return words, np.searchsorted(of, at), shingles, np.searchsorted(doc, at)


def digests(words: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A digest of each text's word sequence."""
    return [xxhash.xxh3_128_digest(words[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]


def sign(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for s in slices(b.column("text")):
                part = b.slice(*s)
                words, w_at, shingles, s_at = shingle_sets(part.column("text"))
                some = np.flatnonzero(s_at[1:] > s_at[:-1])
                sig: list[bytes | None] = [None] * s[1]
                if len(some):
                    for k, x in zip(some, signatures(shingles, s_at[some]), strict=True):
                        sig[k] = x.tobytes()
                n = [len(np.unique(shingles[i:j])) for i, j in zip(s_at[:-1], s_at[1:], strict=True)]
                size = np.diff(text_buffer(part.column("text"))[1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests(words, w_at), pa.binary()), pa.array(n, pa.int64()), pa.array(size), pa.array(sig, pa.binary())], names=[c.split()[0] for c in SIGNED.split(", ")])

    return documents(docs).mapInArrow(run, SIGNED)


def keys(reps: DataFrame) -> DataFrame:
    """(key, id) for each representative and each allowed chunk error."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, SIZE)
                ids = part.column("id").to_numpy()
                out = []
                for c in range(CHUNKS):
                    own = sig[:, c * CHUNK : (c + 1) * CHUNK].astype(U)
                    for left_out in range(CHUNK):
                        h = np.full(len(own), c * CHUNK + left_out + 1, U)
                        for k in range(CHUNK):
                            if k != left_out:
                                h = (h << U(16)) | own[:, k]
                        out.append(mix(h).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.tile(ids, SIZE))], names=["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def dealt(rows: DataFrame, blocks: str) -> DataFrame:
    """Rows with the columns i, j: each row in one of its group's blocks (i), a pivot in all of them; j is 0."""
    own = F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    at = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)).otherwise(F.array(own))
    return rows.withColumn("i", F.explode(at)).withColumn("j", F.lit(0)).drop("pivot", blocks)


def crossed(rows: DataFrame, by: str) -> DataFrame:
    """Rows (by, id, label, weight) of large groups for the second round: i, j, left. The group's rows are dealt over blocks i, and those outside its largest part (left), which must meet the others, over blocks j; each side is in all blocks of the other. Groups of one part go.

    weight: the share of a block that a row takes up.
    """
    parts = rows.groupBy(by, "label").agg(F.sum("weight").alias("w"))
    total = parts.groupBy(by).agg(F.sum("w").alias("all"), F.max_by("label", F.struct("w", "label")).alias("top"), F.max("w").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    apart = skew_join(rows, total.select(by, "top", F.ceil("all").cast("int").alias("ni"), F.ceil(F.col("all") - F.col("most")).cast("int").alias("nj")), by)
    hashed = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    right = apart.withColumn("i", hashed("ni")).withColumn("j", every("nj")).withColumn("left", F.lit(False))
    left = apart.where("label <> top").withColumn("j", hashed("nj")).withColumn("i", every("ni")).withColumn("left", F.lit(True))
    return right.unionByName(left).drop("top", "ni", "nj", "weight")


def grouped(batches, columns: tuple[str, ...], enough: int, most: int = 64 << 20):
    """Tables of whole groups (equal values of columns, rows sorted by them) with about `enough` rows or `most` bytes: (table, group starts)."""
    parts, n, size = [], 0, 0
    for b in batches:
        parts.append(pa.Table.from_batches([b]))
        n, size = n + b.num_rows, size + b.nbytes
        if n < enough and size < most:
            continue
        rest = pa.concat_tables(parts)
        start = group_starts(rest, columns)
        if start[-1]:
            yield rest.slice(0, start[-1]).combine_chunks(), start[:-1]
            rest = rest.slice(start[-1])
        parts, n, size = [rest], rest.num_rows, rest.nbytes
    if n:
        rest = pa.concat_tables(parts).combine_chunks()
        yield rest, group_starts(rest, columns)


def group_starts(t: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in columns:
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def distances(sig: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Differing symbols between each of rows and all signatures."""
    d = np.full((len(rows), len(sig)), SIZE, np.uint8)
    for k in range(SIZE):
        d -= sig[rows, k][:, None] == sig[:, k][None, :]
    return d


class Parts:
    """Which rows are connected: a label for each."""

    def __init__(self, label: np.ndarray):
        self.label = label.copy()

    def join(self, x: int, y: int) -> None:
        a, b = self.label[x], self.label[y]
        self.label[self.label == max(a, b)] = min(a, b)

    def outside(self) -> np.ndarray:
        """The rows that are not in the largest part."""
        names, at, n = np.unique(self.label, return_inverse=True, return_counts=True)
        return np.flatnonzero(at != np.argmax(n))


def connect(sig: np.ndarray, distance: int, agree=None, label: np.ndarray | None = None, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (x, y) of rows up to `distance` apart, and alike by agree(x, y) if given, that connect all that such links connect.

    label: parts that are connected already; left: only these rows meet the others. Else a few rows meet all; those still outside the largest part then do, too. So of any two rows in different parts one has met the other.
    """
    parts = Parts(np.arange(len(sig)) if label is None else label)
    out: list[tuple[int, int]] = []

    def meet(rows: np.ndarray) -> None:
        step = max(1, 2_000_000 // (len(sig) + 1))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            d = distances(sig, part)
            a, b = np.nonzero((d <= distance) & (parts.label[part][:, None] != parts.label[None, :]))
            order = np.argsort(d[a, b], kind="stable")
            for x, y in zip(part[a[order]].tolist(), b[order].tolist(), strict=True):
                if parts.label[x] != parts.label[y] and (agree is None or agree(x, y)):
                    parts.join(x, y)
                    out.append((x, y))

    if left is not None:
        meet(left)
        return out
    meet(np.zeros(1, np.int64))
    for _ in range(PIVOTS):
        rest = parts.outside()
        if len(rest) > 1:
            meet(rest[:1])
    meet(parts.outside())
    return out


def signatures_of(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SIZE)


def links_of(ids: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    """Links between ids that connect what pairs of rows connect."""
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    nodes, at = np.unique(ids, return_inverse=True)
    label = local_components(at[a], at[b], len(nodes))
    x = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[label[x]])], names=["a", "b"]) if len(x) else None


def small_pairs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within groups, for groups of a few rows."""
    a, b = [], []
    for n in np.unique(size[size > 1]):
        x, y = np.triu_indices(n, 1)
        s = start[size == n]
        a.append((s[:, None] + x).ravel())
        b.append((s[:, None] + y).ravel())
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


FEW = 12


def as_pairs(start: int, found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array(found, np.int64).reshape(-1, 2) + start
    return pairs[:, 0], pairs[:, 1]


def candidate_links(buckets: DataFrame, distance: int, second: bool = False) -> DataFrame:
    """(a, b) links that connect what is close within blocks (key, i, j, id, sig); second: of the second round, with label and left."""

    def run(batches):
        for t, start in grouped(batches, ("key", "i", "j"), 50_000):
            sig, ids = signatures_of(t), t.column("id").to_numpy()
            size = np.diff(np.append(start, t.num_rows))
            pairs = []
            few = size <= (0 if second else FEW)
            a, b = small_pairs(start[few], size[few])
            for at in range(0, len(a), 100_000):
                x, y = a[at : at + 100_000], b[at : at + 100_000]
                near = (sig[x] != sig[y]).sum(1) <= distance
                pairs.append((x[near], y[near]))
            for s, n in zip(start[~few], size[~few], strict=True):
                own = (t.column("label").to_numpy()[s : s + n], np.flatnonzero(t.column("left").to_numpy()[s : s + n])) if second else (None, None)
                pairs.append(as_pairs(s, connect(sig[s : s + n], distance, None, *own)))
            if (out := links_of(ids, pairs)) is not None:
                yield out

    return buckets.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def verified_links(groups: DataFrame, percent: int, distance: int, second: bool = False) -> DataFrame:
    """(a, b) links that connect what is similar by full shingle sets within blocks (root, i, j, id, digest, text); rows whose text isn't that of digest go. second: of the second round, with label and left."""

    def run(batches):
        for t, start in grouped(batches, ("root", "i", "j"), TEXT_ROWS, TEXT_BYTES):
            size = np.diff(np.append(start, t.num_rows))
            texts = t.column("text").combine_chunks() if isinstance(t.column("text"), pa.ChunkedArray) else t.column("text")
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            sets, sig, own = [], np.zeros((t.num_rows, SIZE), np.uint16), []
            for s in slices(texts):
                words, w_at, shingles, at = shingle_sets(texts.slice(*s))
                sets += [np.unique(shingles[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                own += digests(words, w_at)
                some = np.flatnonzero(at[1:] > at[:-1])
                if len(some):
                    sig[s[0] + some] = signatures(shingles, at[some])
            right = np.array([x == y and len(z) > 0 for x, y, z in zip(own, t.column("digest").to_pylist(), sets, strict=True)], bool)
            ids, pairs = t.column("id").to_numpy(), []
            for s, n in zip(start, size, strict=True):
                rows = s + np.flatnonzero(right[s : s + n])
                if len(rows) > 1:
                    more = (t.column("label").to_numpy()[rows], np.flatnonzero(t.column("left").to_numpy()[rows])) if second else (None, None)
                    found = connect(sig[rows], distance, lambda x, y, rows=rows: similar(sets[rows[x]], sets[rows[y]], percent), *more)
                    a, b = as_pairs(0, found)
                    pairs.append((rows[a], rows[b]))
            if (out := links_of(ids, pairs)) is not None:
                yield out

    return groups.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y| for sorted distinct arrays."""
    short, long = sorted((len(x), len(y)))
    if 100 * short < percent * long:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs merge
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (short + long - common)


def pivots(rows: DataFrame, by: str) -> DataFrame:
    """(by, pivot_ids): up to PIVOTS rows of each group, those with the smallest hashes."""
    least = [F.min(F.struct(F.xxhash64("id", F.lit(k)), "id"))["id"] for k in range(PIVOTS)]
    return rows.groupBy(by).agg(F.array_distinct(F.array(*least)).alias("pivot_ids"))


def labelled(rows: DataFrame, rooted: DataFrame) -> DataFrame:
    """rows with label: the smallest id that theirs is connected with."""
    return rows.join(rooted.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("root_of", "id")).drop("root_of")


def candidate_groups(reps: DataFrame, distance: int) -> DataFrame:
    """(node, root) of representatives that signatures up to `distance` apart connect."""
    all_keys = keys(reps)
    shared = all_keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(skew_join(all_keys, shared, "key").select("key", "id", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key-members")
    sig = reps.select("id", "sig")
    large = members.where("blocks > 1")
    at = skew_join(large, pivots(large, "key"), "key").select("key", "id", "blocks", F.array_contains("pivot_ids", F.col("id")).alias("pivot"))
    first = dealt(at.unionByName(members.where("blocks = 1").withColumn("pivot", F.lit(False))), "blocks")
    links = saved(candidate_links(first.join(sig, "id"), distance), "candidate-links")
    rooted = components(links)
    if large.isEmpty():
        return rooted
    # A row has CHUNKS * CHUNK keys at most: they wait in an array while its label is joined.
    by_row = labelled(large.groupBy("id").agg(F.collect_list("key").alias("keys")), rooted.withColumnRenamed("root", "root_of"))
    own = by_row.select(F.explode("keys").alias("key"), "id", "label", F.lit(1 / BLOCK).alias("weight"))
    more = saved(candidate_links(crossed(own, "key").join(sig, "id"), distance, second=True), "candidate-links")
    return rooted if more.isEmpty() else components(links.unionByName(more))


def near_dedup(docs: DataFrame, percent: int = PERCENT, distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Null texts count as empty; texts without words have no shingles and link with nothing. Texts with one word sequence are linked whatever their number. A null doc_id takes no part: its component is null and kept is false. Rows that repeat an id are linked by the texts of all of them. Other columns are not looked at. Empty input: empty output.
    """
    signed = saved(sign(docs), "signatures")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = saved(usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig"), F.max("size").alias("size")), "representatives")
    rooted = candidate_groups(reps, distance)
    members = rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "id")
    weighed = members.join(reps.select("id", "digest", (F.greatest(F.lit(1 / TEXT_ROWS), F.col("size") / TEXT_BYTES)).alias("weight")), "id")
    weighed = saved(weighed, "candidate-groups")
    sizes = weighed.groupBy("root").agg(F.ceil(F.sum("weight")).cast("int").alias("blocks"))
    sized = saved(skew_join(weighed, sizes, "root"), "candidate-blocks")
    large = sized.where("blocks > 1")
    at = skew_join(large, pivots(large, "root"), "root").withColumn("pivot", F.array_contains("pivot_ids", F.col("id"))).drop("pivot_ids")
    first = dealt(at.unionByName(sized.where("blocks = 1").withColumn("pivot", F.lit(False))), "blocks").drop("weight")
    links = saved(verified_links(with_texts(docs, first), percent, distance), "links")
    linked = components(links)
    if not large.isEmpty():
        own = labelled(large.select("root", "id", "digest", "weight"), linked.withColumnRenamed("root", "root_of"))
        more = saved(verified_links(with_texts(docs, crossed(own, "root")), percent, distance, second=True), "links")
        if not more.isEmpty():
            linked = components(links.unionByName(more))
    classes = usable.select("doc_id", "digest").distinct().join(reps.select("digest", "id"), "digest")
    by_class = classes.join(linked.withColumnRenamed("node", "id"), "id", "left").select("doc_id", F.coalesce("root", "id").alias("component_id"))
    own = by_class.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(own, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def with_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (id, ...) with the texts of their ids; an id with several texts comes with each, and the digest tells which is meant."""
    wanted = saved(rows, "wanted-texts")
    few = wanted.count() <= BROADCAST_IDS
    return documents(docs).withColumnRenamed("doc_id", "id").join(F.broadcast(wanted) if few else wanted, "id")
