"""Literal search in pseudocode lines, across images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import ascii_lower, lines


def folded(c: Column, ignore_case: bool) -> Column:
    return ascii_lower(c) if ignore_case else c


def line_table(decompilation: DataFrame) -> DataFrame:
    """(image_id, function, line from 1, text) for every line; no line after a final new line."""
    return decompilation.where("pseudocode IS NOT NULL AND plain > 0").select("image_id", "function", F.posexplode(lines("pseudocode")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def grep(decompilation: DataFrame, pattern: str, crossing: DataFrame | None = None, ignore_case: bool = False) -> DataFrame:
    """Hits (image_id, function, line, text, via_island): lines that contain the pattern, or that mention the cell of an island whose symbol does.

    crossing: (island, symbol). Of several such islands in a line the lowest is named, and all its mentions are replaced by the symbol. Placeholders are extracted and joined by number, so no line meets all islands.
    """
    if not pattern:
        raise ValueError("the pattern is empty")
    needle = pattern.translate({c: c + 32 for c in range(65, 91)}) if ignore_case else pattern
    # The document as a whole is tested first: most texts go before their lines are made.
    hit = folded(F.col("text"), ignore_case).contains(needle)
    plain = line_table(decompilation.where(folded(F.col("pseudocode"), ignore_case).contains(needle))).where(hit).select("image_id", "function", "line", "text", F.lit(False).alias("via_island"))
    if crossing is None:
        return plain
    own = crossing.where(folded(F.col("symbol"), ignore_case).contains(needle)).select("island", "symbol")
    mention = r"MEMORY\[0x([0-9A-F]{1,15})\]"
    marked = line_table(decompilation.where(F.col("pseudocode").contains("MEMORY[0x"))).where(F.col("text").contains("MEMORY[0x") & ~hit)
    cells = marked.withColumn("cell", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(mention), F.lit(1))))).withColumn("island", F.conv("cell", 16, 10).cast("long"))
    named = cells.join(own, "island").groupBy("image_id", "function", "line", "text").agg(F.min(F.struct("island", "symbol", "cell")).alias("first"))
    text = F.replace("text", F.concat(F.lit("MEMORY[0x"), F.col("first.cell"), F.lit("]")), F.col("first.symbol"))
    return plain.unionByName(named.select("image_id", "function", "line", text.alias("text"), F.lit(True).alias("via_island")))


def limited(hits: DataFrame, images: DataFrame, limit: int = 200) -> DataFrame:
    """The first hits in catalogue order, one more than the limit: its presence tells that the search stopped. 0: all."""
    ordered = hits.join(images.select("image_id", "path"), "image_id").orderBy("path", "function", "line")
    return ordered.limit(limit + 1) if limit else ordered


#: What became of an image in a search.
SEARCHED, NOT_SEARCHED, NOT_REACHED = "searched", "not searched", "not reached"


def searched(images: DataFrame, decompilation: DataFrame, call: DataFrame, partial: DataFrame | None = None, stop: str | None = None) -> DataFrame:
    """(path, fate, partial, functions, refused, indexed) of each image chosen.

    Images come in order of path; stop: the path of the hit beyond the limit, after which none is reached. An image without pseudocode is not searched; one whose store is partial is searched and named; functions without text are refused; an image without calls has no islands to resolve.
    """
    texts = decompilation.groupBy("image_id").agg(F.count("*").alias("functions"), F.count_if(F.col("pseudocode").isNull() | (F.col("plain") == 0)).alias("refused"))
    rows = images.select("image_id", "path").join(texts, "image_id", "left").join(call.select("image_id").distinct().withColumn("indexed", F.lit(True)), "image_id", "left")
    rows = rows.withColumn("part", F.lit(False)) if partial is None else rows.join(partial.select("image_id").distinct().withColumn("part", F.lit(True)), "image_id", "left")
    late = F.lit(False) if stop is None else F.col("path") > stop
    fate = F.when(late, NOT_REACHED).when(F.col("functions").isNull(), NOT_SEARCHED).otherwise(SEARCHED)
    own = F.col("fate") == SEARCHED
    zero = F.lit(0).cast("long")
    return rows.withColumn("fate", fate).select(
        "path", "fate", (own & F.coalesce("part", F.lit(False))).alias("partial"), F.when(own, F.col("functions")).otherwise(zero).alias("functions"), F.when(own, F.col("refused")).otherwise(zero).alias("refused"), F.coalesce("indexed", F.lit(False)).alias("indexed")
    )


def accounting(seen: DataFrame) -> DataFrame:
    """One row: images selected, searched, not searched, not reached, partial, unindexed; functions searched and refused."""
    zero = F.lit(0).cast("long")
    return seen.agg(
        F.count("*").alias("selected"), *[F.count_if(F.col("fate") == k).alias(k.replace(" ", "_")) for k in (SEARCHED, NOT_SEARCHED, NOT_REACHED)], F.count_if("partial").alias("partial"),
        F.count_if((F.col("fate") == SEARCHED) & ~F.col("indexed")).alias("unindexed"), F.coalesce(F.sum("functions"), zero).alias("functions"), F.coalesce(F.sum("refused"), zero).alias("refused"),
    )


def selected_images(image: DataFrame, names: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Images by basename, and the names that no image has."""
    if not names:
        return image, []
    base = F.substring_index("path", "/", -1)
    known = {r["b"] for r in image.where(base.isin(names)).select(base.alias("b")).distinct().collect()}  # at most the names given
    return image.where(base.isin(names)), [n for n in names if n not in known]
