"""Point and range questions over call edges, references, functions and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.asof import containing, range_join


def image_coverage(image: DataFrame, coverage: DataFrame, layer: str = "Facts") -> DataFrame:
    """Every image with its coverage of a layer, zeros where none is stored."""
    own = coverage.where(F.col("layer") == layer).select("path", "unit", "read", "total")
    zero = F.lit(0).cast("long")
    return image.join(own, "path", "left").select("path", "name", "facts_state", F.coalesce("tower", F.lit("")).alias("tower"), F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("read", zero).alias("read"), F.coalesce("total", zero).alias("total"))


def done(image: DataFrame) -> DataFrame:
    return image.where("facts_state = 'FactsDone'")


def header(image: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: finished images and their summed coverage."""
    all_rows = image_coverage(done(image), coverage)
    zero = F.lit(0).cast("long")
    return all_rows.agg(F.count("*").alias("images"), F.coalesce(F.sum("read"), zero).alias("read"), F.coalesce(F.sum("total"), zero).alias("total"))


def callers(call: DataFrame, image: DataFrame, target: int) -> DataFrame:
    """All call sites with a target, over finished images, whatever their kind."""
    return call.where(F.col("target") == target).join(done(image).select("image_id", "path"), "image_id").select("path", "site", "caller", "via", "island")


def callees(call: DataFrame, caller: int) -> DataFrame:
    return call.where(F.col("caller") == caller).select("site", "target", "via")


def callees_of_start(call: DataFrame, function: DataFrame, address: int) -> DataFrame:
    """Callees, only if the address is exactly a function's start."""
    return callees(call, address).join(function.where(F.col("address") == address).select(F.col("address").alias("caller")).limit(1), F.lit(True), "left_semi")


def references(literal: DataFrame, start: int, end: int | None = None, image_id: int | None = None) -> DataFrame:
    """Literal references with a target in [start, end); by default the one address. image_id: only that image's store is read."""
    found = literal.where((F.col("target") >= start) & (F.col("target") < (start + 1 if end is None else end)))
    return found if image_id is None else found.where(F.col("image_id") == image_id)


def family(virtual_call: DataFrame, site: int) -> DataFrame:
    return virtual_call.where(F.col("site") == site)


def function_sizes(starts: DataFrame, text_end: Column) -> DataFrame:
    """(image_id, address, size): up to the next start of the image, the last one to the end of its text."""
    after = F.lead("address").over(W.partitionBy("image_id").orderBy("address"))
    return starts.select("image_id", "address", (F.coalesce(after, text_end) - F.col("address")).alias("size"))


def containing_function(addresses: DataFrame, function: DataFrame, key: str = "address_of") -> DataFrame:
    """Addresses with the function that holds them; nulls between or before functions."""
    return containing(addresses, function.select("image_id", "address", "size"), ["image_id"], key)


def first_containing(addresses: DataFrame, function: DataFrame, image: DataFrame, key: str = "address_of") -> DataFrame:
    """Addresses with the first finished image (by path) one of whose functions holds them, and that function; others are left out."""
    width = 1 << 12
    real = function.where("size > 0").join(done(image).select("image_id", "path"), "image_id")
    held = range_join(addresses, real.select("path", "address", "size"), key, "address", "size", width)
    return first_per(held.select(key, "path", "address", "size"), [key], "path", F.desc("address"))


def owners(addresses: DataFrame, segment: DataFrame, key: str = "at") -> DataFrame:
    """Addresses with the image whose segment owns them: shared and empty segments own nothing."""
    real = segment.where("name <> '__LINKEDIT' AND size > 0")
    return range_join(addresses, real, key, "address", "size", how="left").select(key, "path", "name")


def first_per(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group in an explicit order."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def islands(call: DataFrame) -> DataFrame:
    """Distinct (image_id, caller, island, target) of calls through islands; of several targets of an island the greatest site's stays."""
    through = call.where("island IS NOT NULL")
    return through.groupBy("image_id", "caller", "island").agg(F.max_by("target", "site").alias("target"))


def resolve_islands(call: DataFrame, segment: DataFrame, symbol: DataFrame) -> DataFrame:
    """Each island with the first image (by path) any of whose segments holds its target, and the smallest symbol exactly there, if any."""
    targets = call.where("island IS NOT NULL").select("island", "target").distinct()
    held = range_join(targets, segment.select(F.col("image_id").alias("owner_id"), "path", "address", "size"), "target", "address", "size")
    first = first_per(held.select("island", "target", "owner_id", "path").distinct(), ["island"], "path")
    names = symbol.groupBy(F.col("image_id").alias("owner_id"), F.col("address").alias("target")).agg(F.min("name").alias("symbol"))
    return first.join(names, ["owner_id", "target"], "left").select("island", "target", "path", "symbol")


def island_symbols(call: DataFrame, segment: DataFrame, symbol: DataFrame) -> DataFrame:
    """Each island with a symbol at its target, from the first image (by path) that holds the target and has one."""
    targets = call.where("island IS NOT NULL").select("island", "target").distinct()
    held = range_join(targets, segment.select(F.col("image_id").alias("owner_id"), "path", "address", "size"), "target", "address", "size")
    names = symbol.groupBy(F.col("image_id").alias("owner_id"), F.col("address").alias("target")).agg(F.min("name").alias("symbol"))
    return first_per(held.join(names, ["owner_id", "target"]).select("island", "target", "path", "symbol").distinct(), ["island"], "path").select("island", "target", "symbol")


def calls_leaving(call: DataFrame, segment: DataFrame) -> DataFrame:
    """Calls of each image whose target lies in none of that image's segments."""
    own = segment.select(F.col("image_id").alias("_image"), "address", "size")
    width = 1 << 18
    listed = own.where("size > 0").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("address") / width), F.floor((F.col("address") + F.col("size") - 1) / width))))
    keyed = call.withColumn("_bucket", F.floor(F.col("target") / width))
    inside = (keyed["_bucket"] == listed["_bucket"]) & (keyed["image_id"] == listed["_image"]) & (keyed["target"] >= listed["address"]) & (keyed["target"] < listed["address"] + listed["size"])
    return keyed.join(listed, inside, "left_anti").drop("_bucket")


def symbol_addresses(symbol: DataFrame, image: DataFrame, name: str) -> DataFrame:
    """The smallest address of a name, raw or demangled, in the first image (by path) that has it."""
    hit = symbol.where(F.col("name") == name).select("image_id", "address").union(symbol.where(F.col("demangled") == name).select("image_id", "address")).distinct()
    return hit.join(done(image).select("image_id", "path"), "image_id").orderBy("path", "address").limit(1).select("path", "address")


def capped(df: DataFrame, order: list[str], cap: int = 10, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(all rows counted, rows shown): counts never depend on the cap."""
    return df.agg(F.count("*").alias("count")), df.orderBy(*order) if full else df.orderBy(*order).limit(cap)


def image_by_name(image: DataFrame, wanted: str) -> DataFrame:
    """The image of an exact path; else of a unique basename; else of a basename unique under /System/Library/ and /usr/. Empty if there is none or a choice."""
    base = F.substring_index("path", "/", -1) == wanted
    system = F.col("path").startswith("/System/Library/") | F.col("path").startswith("/usr/")
    ranked = image.where((F.col("path") == wanted) | base).select("image_id", "path", F.when(F.col("path") == wanted, 0).when(system, 1).otherwise(2).alias("rank"))
    stats = ranked.agg(F.min("rank").alias("best"), F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("system"))
    allowed = (F.col("best") == 0) & (F.col("rank") == 0) | (F.col("best") > 0) & ((F.col("n") == 1) | (F.col("system") == 1) & (F.col("rank") == 1))
    return ranked.join(F.broadcast(stats), F.lit(True)).where(allowed).select("image_id", "path")


def store_names(requests: DataFrame) -> DataFrame:
    """(path, store): base.db, base-2.db and so on for repeated basenames, in request order; a path asked twice counts once."""
    once = requests.groupBy("path").agg(F.min("position").alias("position"))
    base = F.substring_index("path", "/", -1)
    k = F.row_number().over(W.partitionBy("base").orderBy("position"))
    return once.withColumn("base", base).withColumn("k", k).select("path", F.concat("base", F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise(""), F.lit(".db")).alias("store"))
