"""Store bookkeeping: coverage, resume, staleness, upserts, build order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the decompiler says of functions over its size limit (fixed value).
TOO_BIG = "function too big"


def pseudocode_coverage(decompilation: DataFrame) -> DataFrame:
    """One row: functions decompiled, attempted, lines, refused for size (where reasons are kept), without text; one pass."""
    zero = F.lit(0).cast("long")
    count = F.size(F.split("pseudocode", "\n", -1)).cast("long")
    refused = F.count_if(F.lower("reason").contains(TOO_BIG)) if "reason" in decompilation.columns else zero
    return decompilation.agg(
        F.count_if(F.col("status") == "Ok").alias("ok"), F.count("*").alias("attempted"), F.coalesce(F.sum(F.when(F.col("pseudocode").isNotNull(), count)), zero).alias("lines"),
        refused.alias("too_big"), F.count_if(F.col("pseudocode").isNull() | (F.col("plain") == 0)).alias("without"),
    )


def complete(meta: DataFrame, stores: DataFrame) -> DataFrame:
    """Stores with their completeness: an absent mark counts as complete."""
    mark = meta.where("key = 'Complete'").select("store", "value")
    return stores.join(mark, "store", "left").select("store", (F.coalesce("value", F.lit("1")) == "1").alias("complete"))


def remaining(work: DataFrame, stored: DataFrame) -> DataFrame:
    """Work whose function is not stored yet."""
    return work.join(stored.select("function").distinct(), "function", "left_anti")


def build_order(work: DataFrame) -> DataFrame:
    """Smallest first; of equal sizes, towers first, then by name."""
    return work.orderBy("bytes", F.col("tower").asc_nulls_last(), "name")


def staleness(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Files by fate: changed (size or time differ), removed, added; equal ones go."""
    s, d = stored.alias("s"), disk.alias("d")
    both = s.join(d, F.col("s.path") == F.col("d.path"), "full_outer")
    fate = F.when(F.col("s.path").isNull(), "added").when(F.col("d.path").isNull(), "removed").when((F.col("s.size") != F.col("d.size")) | (F.col("s.mtime") != F.col("d.mtime")), "changed")
    return both.select(F.coalesce("s.path", "d.path").alias("path"), fate.alias("fate")).where("fate IS NOT NULL")


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with the rows of the same keys replaced."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order: the last write wins."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*key, "x.*")


def completed_facts(image: DataFrame, coverage: DataFrame) -> DataFrame:
    """Images that a resumed build skips: done, with plausible coverage in instructions."""
    good = coverage.where("layer = 'Facts' AND unit = 'instructions' AND read >= 0 AND read <= total AND total > 0")
    return image.where("facts_state = 'FactsDone'").join(good.select("path"), "path", "left_semi")


def recorded(image: DataFrame, coverage: DataFrame, built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image, coverage) after a build's rows (path, facts_state, reason, read, total): states and coverage are replaced, a failed image loses its coverage; but a failure over a store that is done and usable records nothing."""
    usable = completed_facts(image, coverage).select("path")
    counts = built.where("facts_state <> 'FactsFailed'").unionByName(built.where("facts_state = 'FactsFailed'").join(usable, "path", "left_anti"))
    states = upsert(image.select("path", "facts_state", "reason"), counts.select("path", "facts_state", "reason"), ["path"])
    others = coverage.where("layer <> 'Facts'").unionByName(coverage.where("layer = 'Facts'").join(counts.select("path"), "path", "left_anti"))
    fresh = counts.where("facts_state = 'FactsDone'").select("path", F.lit("Facts").alias("layer"), F.lit("instructions").alias("unit"), "read", "total")
    return states, others.unionByName(fresh)


def reset_running(image: DataFrame, state: str = "hexrays_state") -> DataFrame:
    """Interrupted exports wait again."""
    return image.withColumn(state, F.when(F.col(state) == "HexRaysRunning", "Pending").otherwise(F.col(state)))


def towers(document: DataFrame, column: str = "json") -> DataFrame:
    """(path, tower) of a tower map: entries of `image`, then of `indexed_non_tower_image`, with a non-empty value."""
    kind = "map<string,string>"
    parsed = document.select(F.from_json(column, f"image {kind}, indexed_non_tower_image {kind}").alias("j"))
    parts = [parsed.select(F.explode(f"j.{c}").alias("path", "tower")) for c in ("image", "indexed_non_tower_image")]
    return parts[0].unionByName(parts[1]).where("tower <> ''")
