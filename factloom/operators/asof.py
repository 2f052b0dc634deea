"""As-of (floor) lookup and interval containment without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_floor(left: DataFrame, right: DataFrame, by: list[str], left_key: str, right_key: str, bucket: int = 1 << 18) -> DataFrame:
    """Each row of left with the columns of right's row of the same `by` values that has the greatest right_key <= left_key; nulls if none.

    Both sides are unioned and carried forward by one window, partitioned by `by` and a bucket of the key, so one large `by` value is spread over tasks; the last row of right before each bucket comes from a table with one row per non-empty bucket. Of equal keys in right, any one counts. Rows whose key or by value is null find nothing.
    """
    own = [c for c in right.columns if c not in by]
    b = [F.col(c) for c in by]
    payload = F.struct(*own)
    lb, rb = F.floor(F.col(left_key) / bucket), F.floor(F.col(right_key) / bucket)
    lrows = left.select(*b, F.col(left_key).alias("_k"), F.lit(1).alias("_side"), lb.alias("_b"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("_r"))
    rrows = right.where(F.col(right_key).isNotNull()).select(*b, F.col(right_key).alias("_k"), F.lit(0).alias("_side"), rb.alias("_b"), F.lit(None).cast(lrows.schema["_l"].dataType).alias("_l"), payload.alias("_r"))
    both = lrows.unionByName(rrows)
    within = W.partitionBy(*by, "_b").orderBy("_k", "_side").rowsBetween(W.unboundedPreceding, 0)
    carried = both.withColumn("_f", F.last("_r", ignorenulls=True).over(within))
    # One row per bucket with the last of right in it or before it.
    tails = both.groupBy(*by, "_b").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_k"))).alias("_tail"))
    before = F.last("_tail", ignorenulls=True).over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    tails = tails.select(*by, "_b", before.alias("_before"))
    joined = carried.where("_side = 1").join(tails, [*by, "_b"], "left")
    found = F.coalesce("_f", "_before")
    return joined.select("_l.*", *[found[c].alias(c) for c in own])


def containing(left: DataFrame, spans: DataFrame, by: list[str], key: str, start: str = "address", size: str = "size") -> DataFrame:
    """asof_floor, with nulls where the floor span ends at or before the key. For disjoint spans this is containment."""
    found = asof_floor(left, spans, by, key, start)
    inside = F.col(key) < F.col(start) + F.col(size)
    own = [c for c in spans.columns if c not in by]
    return found.select(*left.columns, *[F.when(inside, F.col(c)).alias(c) for c in own])


def range_join(left: DataFrame, spans: DataFrame, key: str, start: str, size: str, width: int = 1 << 18, how: str = "inner") -> DataFrame:
    """Rows of left with every span that holds their key, spans may overlap: an equi join on key buckets, each span listed once per bucket it touches.

    Spans much wider than `width` multiply; choose width near the largest span. how: inner, left, left_semi or left_anti.
    """
    listed = spans.where(F.col(size) > 0).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(start) + F.col(size) - 1) / width))))
    keyed = left.withColumn("_bucket", F.floor(F.col(key) / width))
    inside = (keyed["_bucket"] == listed["_bucket"]) & (keyed[key] >= listed[start]) & (keyed[key] < listed[start] + listed[size])
    return keyed.join(listed, inside, how).drop("_bucket")
