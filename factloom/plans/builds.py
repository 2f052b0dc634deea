"""Builds: facts from binaries, documents from a corpus, pseudocode from batches. Each ends in a store that readers see whole."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.functions.binary import mnemonic, operands
from factloom.operators import binary, lookup, stores
from factloom.plans.verdict import EMPTY, FOUND, PARTIAL, Refusal, Verdict
from factloom.session import saved
from factloom.sources import corpus, macho
from factloom.sources.config import Config
from factloom.sources.stores import Store, write


#: Names of tables of virtual functions (fixed value).
TABLE_SYMBOL = "__ZTV"


def facts(spark: SparkSession, path: str, cells: DataFrame | None = None, done: DataFrame | None = None, demangle: Callable[[str], str | None] | None = None, wanted: DataFrame | None = None) -> dict[str, DataFrame]:
    """Fact tables of all Mach-O files under a path. cells: decoded pointers (at, target), for islands and tables of virtual functions (else plain pointers into the images' own segments count); done: paths that a resumed build skips; demangle: a name's plain form or None; wanted: (base, tower) of the basenames that are built, all files without it.

    All images go through the same stages at once; an image is a key, not a job. A malformed file is an image that failed, with the reason.
    """

    base = F.substring_index("file", "/", -1)

    def skipped(rows: DataFrame) -> DataFrame:
        if wanted is not None:
            rows = rows.join(wanted.select(F.col("base").alias("_base")), base == F.col("_base"), "left_semi")
        return rows if done is None else rows.join(done.select(F.col("path").alias("file")), "file", "left_anti")

    def read(table: str) -> DataFrame:
        return skipped(macho.read(spark, path, table, strict=False)).join(good, "file", "left_semi").withColumn("image_id", F.xxhash64("file"))

    state = saved(skipped(macho.failures(spark, path)), "file-states")
    good = state.where("reason IS NULL").select("file")
    segment = saved(read("segment"), "segments")
    text = saved(read("section").where("name = '__TEXT.__text'").select("image_id", "address", "size"), "text-sections")
    words = read("word").join(text, "image_id").where("va >= address AND va < address + size").select("image_id", "va", "word")
    code = saved(words.select("image_id", "va", mnemonic(F.col("word")).alias("mnemonic"), operands(F.col("word"), F.col("va")).alias("operands")), "instructions")
    instr = code.where("mnemonic IS NOT NULL")
    ends = text.select("image_id", (F.col("address") + F.col("size")).alias("text_end"))
    starts = binary.function_starts(read("function_starts"))
    function = saved(lookup.function_sizes(starts.join(ends, "image_id"), F.col("text_end")).withColumn("source", F.lit("FunctionStarts")), "functions")
    owned = segment.where("name <> '__LINKEDIT' AND size > 0").select("address", "size")
    raw = read("cell").select("at", "raw")
    if cells is None:
        cells = binary.range_join(raw.where("raw > 0").withColumnRenamed("raw", "target"), owned.distinct(), "target", "address", "size", how="left_semi")
    hop = binary.hops(instr).join(cells.select(F.col("at").alias("pointer"), "target"), "pointer", "left").select("island", F.coalesce("next", "target").alias("next"))
    sites = instr.where("mnemonic = 'bl'").select(binary.immediate(F.col("operands")).alias("island"))
    outside = binary.range_join(sites.distinct(), text, "island", "address", "size", how="left_anti")
    resolved = binary.resolve(outside, hop, owned)
    symbol = saved(binary.filtered_symbols(read("symbol")), "symbols")
    tables = symbol.where(F.col("name").startswith(TABLE_SYMBOL)).groupBy("address").agg(F.min("name").alias("ztv"))
    names = symbol.groupBy(F.col("address").alias("target")).agg(F.min("name").alias("name"))
    virtual = binary.virtual_sites(instr, function)
    seen = code.groupBy("image_id").agg(F.count("mnemonic").alias("read"), F.count("*").alias("total"))
    header = segment.groupBy("image_id").agg(F.min("address").alias("header"))
    image = state.select(F.xxhash64("file").alias("image_id"), F.col("file").alias("path"), F.when(F.col("reason").isNull(), "FactsDone").otherwise("FactsFailed").alias("facts_state"), "reason").join(header, "image_id", "left")
    towers = wanted.select("base", "tower") if wanted is not None else spark.createDataFrame([], "base string, tower string")
    image = image.withColumn("base", F.substring_index("path", "/", -1)).join(towers, "base", "left")
    paths = image.select("image_id", "path")
    plain = F.lit(None).cast("string") if demangle is None else demangled(demangle)("name")
    return {
        "image": image.select("image_id", "path", "tower", "header", "facts_state", "reason"),
        "coverage": seen.join(paths, "image_id").select("path", F.lit("Facts").alias("layer"), F.lit("instructions").alias("unit"), "read", "total"),
        "segment": segment.join(paths, "image_id").select("image_id", "path", "name", "address", "size"),
        "section": read("section").select("image_id", "name", "address", "size"),
        "function": function,
        "symbol": symbol.withColumn("demangled", plain),
        "call": binary.calls(instr, function, text, resolved),
        "literal": binary.literal_values(binary.literal_reads(instr), raw),
        "virtual_site": virtual,
        "virtual_call": binary.families(virtual, tables, cells, names),
        "instruction": code,
    }


def demangled(demangle: Callable[[str], str | None]):
    """A column function from a hook; a name that it refuses has no plain form."""

    @F.arrow_udf(StringType())
    def plain(names: pa.Array) -> pa.Array:
        return pa.array([None if n is None else demangle(n) for n in names.to_pylist()], pa.string())

    return plain


def tower_map(spark: SparkSession, path: str) -> DataFrame:
    """(base, tower) of a tower map file: the basenames of its images."""
    rows = stores.towers(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))
    return rows.groupBy(F.substring_index("path", "/", -1).alias("base")).agg(F.min("tower").alias("tower"))


def build_facts(spark: SparkSession, path: str, store: str, resume: bool = False, cells: DataFrame | None = None, demangle: Callable[[str], str | None] | None = None, wanted: DataFrame | None = None) -> Verdict:
    """A catalogue store of the images under a path. resume: images that are done with plausible coverage keep their rows and are not read again. An image that fails now, but was done before, keeps what it had; other failed images make the answer PARTIAL."""
    try:
        old = Store(spark, store, "Catalog")
    except Refusal as e:
        if resume or e.code != "NotFound":
            raise
        old = None
    usable = saved(stores.completed_facts(old.table("image"), old.table("coverage")).select("image_id", "path"), "usable") if old else None
    tables = facts(spark, path, cells, usable if resume else None, demangle, wanted)
    if old:
        kept = usable if resume else saved(usable.join(tables["image"].where("facts_state = 'FactsFailed'").select("path"), "path", "left_semi"), "kept")
        if not kept.isEmpty():
            for name, new in tables.items():
                key = "path" if name == "coverage" else "image_id"
                tables[name] = old.table(name).join(kept.select(key), key, "left_semi").unionByName(new.join(kept.select(key), key, "left_anti"))
    write(spark, store, "Catalog", tables)
    opened = Store(spark, store, "Catalog")
    r = lookup.header(opened.table("image").withColumn("name", F.col("path")), opened.table("coverage")).first()
    failed = opened.table("image").where("facts_state <> 'FactsDone'").count()
    if failed:
        return Verdict(PARTIAL, r["images"], f"{failed} of {failed + r['images']} images failed", r["read"], r["total"])
    return Verdict(FOUND if r["images"] else EMPTY, r["images"], read=r["read"], total=r["total"])


def build_documents(spark: SparkSession, root: str, config: Config, store: str, head: str | None = None) -> Verdict:
    """A documents store of a corpus, bound to its configuration (and commit) by meta rows."""
    tables = corpus.build(spark, root, config)
    write(spark, store, "Documents", tables, {"Head": head} if head else None)
    opened = Store(spark, store, "Documents", ConfigSha256=config.sha256)
    r = opened.table("coverage").agg(F.sum("read").alias("read"), F.sum("total").alias("total")).first()
    n = opened.table("section").count() if "section" in tables else 0
    return Verdict(FOUND if n else EMPTY, n, read=r["read"] or 0, total=r["total"] or 0)


def next_batch(work: DataFrame, stored: DataFrame, size: int = 1000) -> DataFrame:
    """The next functions to decompile: those not stored, in build order."""
    return stores.build_order(stores.remaining(work, stored)).limit(size)


DECOMPILED = "image_id long, function long, pseudocode string, plain long, status string, reason string, seconds double"


def pseudocode(spark: SparkSession, store: str) -> tuple[DataFrame, bool]:
    """(rows, complete) of a pseudocode store; without one: no rows, not complete."""
    try:
        rows = spark.read.schema(DECOMPILED).parquet(f"{store}/rows")
    except AnalysisException:
        return spark.createDataFrame([], DECOMPILED), False
    try:
        mark = spark.read.text(f"{store}/complete").first()
    except AnalysisException:
        mark = None
    return rows, mark is not None and mark[0] == "1"


def build_pseudocode(spark: SparkSession, work: DataFrame, decompile: Callable[[dict], tuple[str | None, str, str | None, float]], store: str, size: int = 1000) -> Verdict:
    """Pseudocode of the functions in work (image_id, function, bytes, tower, name, and what decompile needs), by a hook that gives (text, status, reason, seconds) for a row.

    A batch of `size` rows is stored as soon as it is done, so an interrupted build goes on where it was; the store is marked complete only at its end. A row whose hook fails is stored as Failed.
    """

    def run(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                try:
                    text, status, reason, seconds = decompile(r)
                except Exception as e:  # noqa: BLE001 - the hook is foreign code, and its failure is a result
                    text, status, reason, seconds = None, "Failed", str(e), 0.0
                rows.append((r["image_id"], r["function"], text, len(text or ""), status, reason, seconds))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECOMPILED.split(", ")])

    stored, complete = pseudocode(spark, store)
    if not complete:
        spark.createDataFrame([("0",)], "value string").coalesce(1).write.mode("overwrite").text(f"{store}/complete")
        while not (batch := next_batch(work, stored, size)).isEmpty():
            batch.mapInPandas(run, DECOMPILED).write.mode("append").option("compression", "zstd").parquet(f"{store}/rows")
            stored, _ = pseudocode(spark, store)
        spark.createDataFrame([("1",)], "value string").coalesce(1).write.mode("overwrite").text(f"{store}/complete")
    r = stores.pseudocode_coverage(stored).first()
    return Verdict(FOUND if r["attempted"] else EMPTY, r["attempted"], read=r["ok"], total=r["attempted"])
