"""The query catalogue over the projected fact model, and each query in DuckDB's SQL.

A query is a function of a Projection; SQL has the same name, after `with_tables`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as text_functions
from factloom.functions.binary import bits, pointer_target
from factloom.functions.text import basename, hex_address, parse_hex
from factloom.operators import binary, documents, fts, grep, lookup, stores
from factloom.operators.asof import asof_floor, range_join
from factloom.plans.verdict import counted, judged
from factloom.sources.projection import BASE, CODE, DATA, IMAGE, ISLANDS, STEP, Projection, with_tables

#: A well-called address, and one in the middle of things.
CALLED, PLACE = 6442506496, BASE + 42 * STEP
LETTERS = ("'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'")
Query = Callable[[Projection], DataFrame]
_QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def one(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _QUERIES[name](Projection(spark, sf_dir))


# -- catalogue, coverage, verdicts ---------------------------------------------------------------------------------------------------------


@query(with_tables("coverage") + "SELECT path, name, facts_state, coalesce(tower, '') AS tower, coalesce(unit, '') AS unit, coalesce(read, 0) AS read, coalesce(total, 0) AS total FROM image LEFT JOIN coverage USING (path)")
def image_coverage_join(p: Projection) -> DataFrame:
    return lookup.image_coverage(p.image, p.coverage)


@query(with_tables("coverage") + "SELECT count(*) AS images, coalesce(sum(read), 0)::BIGINT AS read, coalesce(sum(total), 0)::BIGINT AS total FROM image LEFT JOIN coverage USING (path) WHERE facts_state = 'FactsDone'")
def catalog_header(p: Projection) -> DataFrame:
    return lookup.header(p.image, p.coverage)


@query(with_tables("coverage") + "SELECT path FROM image JOIN coverage USING (path) WHERE facts_state = 'FactsDone' AND unit = 'instructions' AND read >= 0 AND read <= total AND total > 0")
def completed_facts(p: Projection) -> DataFrame:
    return stores.completed_facts(p.image, p.coverage).select("path")


@query(
    with_tables("call", "coverage")
    + f"""SELECT CASE WHEN count > 0 THEN 'FOUND' WHEN read = total THEN 'EMPTY' ELSE 'PARTIAL' END AS verdict, count, read, total FROM
    (SELECT count(*) AS count FROM call JOIN image USING (image_id) WHERE target = {CALLED} AND facts_state = 'FactsDone'),
    (SELECT coalesce(sum(read), 0)::BIGINT AS read, coalesce(sum(total), 0)::BIGINT AS total FROM image LEFT JOIN coverage USING (path) WHERE facts_state = 'FactsDone')"""
)
def callers_verdict(p: Projection) -> DataFrame:
    return counted(lookup.callers(p.calls(CALLED), p.image, CALLED), lookup.header(p.image, p.coverage))


@query(
    with_tables("call", "coverage")
    + """SELECT path, coalesce(n, 0) AS count, coalesce(read, 0) AS read, coalesce(total, 0) AS total, CASE WHEN coalesce(n, 0) > 0 THEN 'FOUND' WHEN coalesce(read, 0) = coalesce(total, 0) THEN 'EMPTY' ELSE 'PARTIAL' END AS verdict
    FROM image LEFT JOIN (SELECT image_id, count(*) AS n FROM call WHERE via = 'Unresolved' AND target % 4096 = 0 GROUP BY image_id) USING (image_id) LEFT JOIN coverage USING (path)"""
)
def verdicts(p: Projection) -> DataFrame:
    """A verdict for each image on one question: unresolved calls to page starts."""
    n = p.call.where("via = 'Unresolved' AND target % 4096 = 0").groupBy("image_id").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    rows = p.image.join(n, "image_id", "left").join(p.coverage.select("path", "read", "total"), "path", "left").select("path", F.coalesce("n", zero).alias("count"), F.coalesce("read", zero).alias("read"), F.coalesce("total", zero).alias("total"))
    return rows.withColumn("verdict", judged(F.col("count"), F.col("read"), F.col("total")))


@query("SELECT source AS root, count(l.doc_id) AS read, count(*) AS total FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def document_coverage(p: Projection) -> DataFrame:
    return p.document_coverage


@query(with_tables("section", "cited_text", "seal_text") + "SELECT (SELECT count(*) FROM section) AS sections, (SELECT count(*) FROM cited_text) AS cited, (SELECT count(*) FROM seal_text) AS sealed")
def layer_counts(p: Projection) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, df in (("sections", p.section), ("cited", p.cited_text), ("sealed", p.seal_text))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*[F.sum(F.when(F.col("what") == k, F.col("n"))).alias(k) for k in ("sections", "cited", "sealed")])


# -- calls, references, functions ------------------------------------------------------------------------------------------------------------


@query(with_tables("call", "image") + f"SELECT path, site, caller, via, island FROM call JOIN image USING (image_id) WHERE target = {CALLED} AND facts_state = 'FactsDone'")
def callers_of(p: Projection) -> DataFrame:
    return lookup.callers(p.calls(CALLED), p.image, CALLED)


@query(with_tables("call") + f"SELECT site, target, via FROM call WHERE caller = {PLACE}")
def callees_of(p: Projection) -> DataFrame:
    return lookup.callees_of_start(p.calls(caller=PLACE), p.function, PLACE)


@query(with_tables("literal") + f"SELECT image_id, site, target, kind FROM literal WHERE target >= {DATA + 800} AND target < {DATA + 1600}")
def refs_range(p: Projection) -> DataFrame:
    return lookup.references(p.literal, DATA + 800, DATA + 1600).select("image_id", "site", "target", "kind")


@query(with_tables("literal") + f"SELECT site, target, kind, value FROM literal WHERE target >= {DATA} AND target < {DATA + 4000} AND value IS NOT NULL AND image_id = 0")
def refs_with_value(p: Projection) -> DataFrame:
    return lookup.references(p.literal, DATA, DATA + 4000, image_id=0).where("value IS NOT NULL").select("site", "target", "kind", "value")


@query(with_tables("function") + "SELECT image_id, address, size FROM function")
def function_sizes_lead(p: Projection) -> DataFrame:
    return lookup.function_sizes(p.function.select("image_id", "address"), BASE + (F.col("image_id") + 1) * IMAGE * STEP)


@query(with_tables("line", "function") + "SELECT l.image_id, l.site, coalesce(f.address, 0) AS caller FROM line l ASOF LEFT JOIN function f ON l.image_id = f.image_id AND l.site >= f.address")
def caller_of_site_asof(p: Projection) -> DataFrame:
    found = asof_floor(p.line.select("image_id", "site"), p.function.select("image_id", "address"), ["image_id"], "site", "address")
    return found.select("image_id", "site", F.coalesce("address", F.lit(0).cast("long")).alias("caller"))


PROBES = f"SELECT (doc_id * 7) % 17 AS image_id, {BASE} - 512 + doc_id * 389 AS address_of FROM documents"


@query(
    with_tables("function", more=f"probe AS ({PROBES})")
    + "SELECT p.image_id, p.address_of, CASE WHEN p.address_of < f.address + f.size THEN f.address END AS address, CASE WHEN p.address_of < f.address + f.size THEN f.size END AS size FROM probe p ASOF LEFT JOIN function f ON p.image_id = f.image_id AND p.address_of >= f.address"
)
def containing_function(p: Projection) -> DataFrame:
    """Probes before the first function, within, and past an image's end."""
    probe = p.table("documents").select((F.col("doc_id") * 7 % 17).alias("image_id"), (BASE - 512 + F.col("doc_id") * 389).alias("address_of"))
    return lookup.containing_function(probe, p.function)


@query(with_tables("call", "function") + "SELECT DISTINCT target FROM call WHERE target IN (SELECT address FROM function)")
def exact_function_semi(p: Projection) -> DataFrame:
    """Call targets that are exactly a function's start."""
    return p.call.select("target").distinct().join(p.function.select(F.col("address").alias("target")), "target", "left_semi")


OWNED = f"SELECT {BASE} - 1000 + doc_id * 70001 AS at FROM documents UNION ALL SELECT {DATA} + doc_id * 4099 FROM documents"


@query(with_tables("segment", more=f"probe AS ({OWNED})") + "SELECT p.at, s.path, s.name FROM probe p LEFT JOIN segment s ON s.name <> '__LINKEDIT' AND s.size > 0 AND p.at >= s.address AND p.at < s.address + s.size")
def address_owner(p: Projection) -> DataFrame:
    d = p.table("documents")
    return lookup.owners(d.select((BASE - 1000 + F.col("doc_id") * 70001).alias("at")).unionAll(d.select((DATA + F.col("doc_id") * 4099).alias("at"))), p.segment)


@query(
    with_tables("symbol", "image")
    + "SELECT path, address FROM (SELECT image_id, address FROM symbol WHERE name = (SELECT min(p_name || '_' || p_partkey) FROM part) UNION SELECT image_id, address FROM symbol WHERE demangled = (SELECT min(p_name || '_' || p_partkey) FROM part)) JOIN image USING (image_id) WHERE facts_state = 'FactsDone' ORDER BY path, address LIMIT 1"
)
def symbol_by_name_union(p: Projection) -> DataFrame:
    name = p.table("part").agg(F.min(F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")))).first()[0]
    return lookup.symbol_addresses(p.symbol, p.image, name)


@query(with_tables("symbol") + "SELECT address, name, demangled FROM symbol WHERE external = 1")
def symbol_decode(p: Projection) -> DataFrame:
    """Names are stored inline (Parquet keeps the dictionary), so decoding needs no join."""
    return p.symbol.where("external = 1").select("address", "name", "demangled")


@query(with_tables("symbol") + "SELECT image_id, address, name, min(external) AS external FROM (SELECT * FROM symbol UNION ALL SELECT * FROM symbol) GROUP BY image_id, address, name")
def symbol_dedupe(p: Projection) -> DataFrame:
    return p.symbol.unionByName(p.symbol).groupBy("image_id", "address", "name").agg(F.min("external").alias("external"))


@query(with_tables("call") + "SELECT image_id, caller, island, max(target) AS target FROM call WHERE island IS NOT NULL GROUP BY image_id, caller, island")
def island_targets_distinct(p: Projection) -> DataFrame:
    return lookup.islands(p.call)


HELD = "SELECT DISTINCT i.island, i.target, s.image_id, s.path FROM (SELECT DISTINCT island, target FROM call WHERE island IS NOT NULL) i JOIN segment s ON i.target >= s.address AND i.target < s.address + s.size"
NAMES = "SELECT image_id, address, min(name) AS symbol FROM symbol GROUP BY image_id, address"


@query(
    with_tables("call", "segment", "symbol", more=f"held AS ({HELD}), names AS ({NAMES})")
    + "SELECT h.island, h.target, h.path, n.symbol FROM (SELECT *, row_number() OVER (PARTITION BY island ORDER BY path) AS k FROM held) h LEFT JOIN names n ON n.image_id = h.image_id AND n.address = h.target WHERE k = 1"
)
def island_resolution(p: Projection) -> DataFrame:
    return lookup.resolve_islands(p.call, p.segment, p.symbol)


@query(
    with_tables("call", "segment", "symbol", more=f"held AS ({HELD}), names AS ({NAMES})")
    + "SELECT island, target, symbol FROM (SELECT h.island, h.target, n.symbol, row_number() OVER (PARTITION BY h.island ORDER BY h.path) AS k FROM held h JOIN names n ON n.image_id = h.image_id AND n.address = h.target) WHERE k = 1"
)
def island_symbols(p: Projection) -> DataFrame:
    return lookup.island_symbols(p.call, p.segment, p.symbol)


@query(with_tables("call", "segment") + "SELECT image_id, count(*) AS leaving FROM call c WHERE NOT EXISTS (SELECT 1 FROM segment s WHERE s.image_id = c.image_id AND c.target >= s.address AND c.target < s.address + s.size) GROUP BY image_id")
def calls_leaving_image(p: Projection) -> DataFrame:
    return lookup.calls_leaving(p.call, p.segment).groupBy("image_id").agg(F.count("*").alias("leaving"))


@query(
    with_tables("call", "image")
    + f"SELECT (SELECT count(*) FROM call JOIN image USING (image_id) WHERE target = {CALLED} AND facts_state = 'FactsDone') AS count, path, site FROM call JOIN image USING (image_id) WHERE target = {CALLED} AND facts_state = 'FactsDone' ORDER BY path, site LIMIT 10"
)
def callers_count_vs_top10(p: Projection) -> DataFrame:
    count, shown = lookup.capped(lookup.callers(p.calls(CALLED), p.image, CALLED), ["path", "site"])
    return shown.select("path", "site").join(F.broadcast(count), F.lit(True))


@query(with_tables("virtual_call") + "SELECT site, slot_offset, discriminator, candidate, candidate_symbol, resolver FROM virtual_call WHERE site = (SELECT min(site) FROM virtual_call)")
def vcall_family(p: Projection) -> DataFrame:
    return lookup.family(p.virtual_call, p.virtual_call.agg(F.min("site")).first()[0])


@query(with_tables("image") + "SELECT image_id, path FROM image WHERE path LIKE '%/' || (SELECT min(s_name) FROM supplier)")
def image_name_resolution(p: Projection) -> DataFrame:
    return lookup.image_by_name(p.image, p.table("supplier").agg(F.min("s_name")).first()[0])


@query(
    "SELECT path, base || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.db' AS store FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY position) AS k FROM (SELECT '/lib/' || n_name || '/' || (s_suppkey % 40) AS path, (s_suppkey % 40)::VARCHAR AS base, min(s_suppkey) AS position FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL))"
)
def store_names(p: Projection) -> DataFrame:
    s = p.table("supplier").join(p.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return lookup.store_names(s.select(F.concat(F.lit("/lib/"), "n_name", F.lit("/"), (F.col("s_suppkey") % 40).cast("string")).alias("path"), F.col("s_suppkey").alias("position")))


@query(with_tables("image") + "SELECT '/t/' || n_name AS path, r_name AS tower FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0")
def tower_explode(p: Projection) -> DataFrame:
    """A tower map as JSON, made from nations; every third entry is empty and goes."""
    j = p.table("nation").join(p.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct(F.concat(F.lit("/t/"), "n_name").alias("k"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("r_name")).alias("v"), (F.col("n_nationkey") % 2).alias("part"))
    maps = j.agg(*[F.map_from_entries(F.transform(F.filter(F.collect_list(entry), part_is(k)), lambda e: F.struct(e["k"], e["v"]))).alias(name) for k, name in enumerate(("image", "indexed_non_tower_image"))])
    return stores.towers(maps.select(F.to_json(F.struct("*")).alias("json")))


def part_is(k: int):
    return lambda e: e["part"] == k


@query("SELECT s_suppkey, '0x' || printf('%x', 6442450944 + s_suppkey) AS address, 6442450944 + s_suppkey AS parsed, NULL::BIGINT AS refused, s_name AS base FROM supplier")
def hex_and_names(p: Projection) -> DataFrame:
    a = BASE + F.col("s_suppkey")
    return p.table("supplier").select("s_suppkey", hex_address(a).alias("address"), parse_hex(hex_address(a)).alias("parsed"), parse_hex(F.concat(hex_address(a), F.lit("g"))).alias("refused"), basename(F.concat(F.lit("/a/b/"), "s_name")).alias("base"))


# -- facts from instructions -----------------------------------------------------------------------------------------------------------------------


#: The text section of an image ends after 400 documents' code; islands whose number is even are known.
TEXT_CODE = 400


@query(
    with_tables("instr", "code_function")
    + f"""SELECT s.image_id, s.site, coalesce(f.address, 0) AS caller, CASE WHEN direct OR raw // {CODE} % 2 = 1 THEN raw ELSE raw + 1 END AS target, CASE WHEN direct THEN NULL ELSE raw END AS island,
    CASE WHEN direct THEN 'Direct' WHEN raw // {CODE} % 2 = 1 THEN 'Unresolved' ELSE 'Island' END AS via
    FROM (SELECT *, raw >= lo AND raw < lo + {TEXT_CODE * CODE} AS direct FROM (SELECT image_id, va AS site, ('0x' || substr(operands, 4))::BIGINT AS raw, {BASE} + image_id * {IMAGE * CODE} AS lo FROM instr WHERE mnemonic = 'bl')) s
    ASOF LEFT JOIN code_function f ON s.image_id = f.image_id AND s.site >= f.address"""
)
def call_extraction(p: Projection) -> DataFrame:
    text = p.code_function.select("image_id").distinct().select("image_id", (BASE + F.col("image_id") * IMAGE * CODE).alias("address"), F.lit(TEXT_CODE * CODE).cast("long").alias("size"))
    raw = binary.immediate(F.col("operands"))
    known = p.instr.where("mnemonic = 'bl'").select(raw.alias("island")).distinct().where(F.floor(F.col("island") / CODE) % 2 == 0).withColumn("target", F.col("island") + 1)
    return binary.calls(p.instr, p.code_function, text, known)


BARRIER_SQL = ", ".join(f"'{b}'" for b in binary.BARRIERS)


@query(
    with_tables("instr", more=f"""code AS (SELECT *, string_split(operands, ', ') AS p, sum(CASE WHEN mnemonic IN ({BARRIER_SQL}) THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY va) AS segment FROM instr),
    events AS (SELECT image_id, va, segment, 1 AS turn, p[1] AS reg, CASE WHEN mnemonic = 'adrp' THEN ('0x' || substr(p[2], 4))::BIGINT ELSE -1 END AS page, NULL AS kind, NULL::BIGINT AS distance FROM code WHERE operands <> ''
        UNION ALL SELECT image_id, va, segment, 0, CASE WHEN mnemonic = 'add' THEN p[2] ELSE substr(p[2], 2) END, NULL, mnemonic, ('0x' || substr(replace(p[3], ']', ''), 4))::BIGINT FROM code WHERE mnemonic IN ('add', 'ldr')),
    known AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY image_id, segment, reg ORDER BY va, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events)""")
    + "SELECT image_id, va AS site, last + distance AS target, kind FROM known WHERE turn = 0 AND last >= 0"
)
def literal_tracker(p: Projection) -> DataFrame:
    return binary.literal_reads(p.instr).select("image_id", "site", "target", "kind")


@query(
    with_tables("instr", "code_function")
    + """SELECT image_id, va AS site, 'blraa x12, x17' AS instruction, doc_id % 16 * 8 AS slot_offset, coalesce(CASE WHEN doc_id % 5 > 0 THEN 1 + doc_id % 999 END, 0) AS discriminator
    FROM instr WHERE mnemonic = 'blraa' AND doc_id % 5 > 0"""
)
def virtual_sites(p: Projection) -> DataFrame:
    """Slot and constant are in the six instructions of each document; a copy in place of the constant leaves the slot unknown."""
    return binary.virtual_sites(p.instr, p.code_function)


@query(with_tables("instr") + "SELECT mnemonic, count(*) AS n, count(DISTINCT image_id) AS images FROM instr GROUP BY mnemonic")
def mnemonic_counts(p: Projection) -> DataFrame:
    return p.instr.groupBy("mnemonic").agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("images"))


@query("SELECT doc_id, 270532608 + doc_id * 8 AS target FROM documents WHERE doc_id % 5 > 0")
def pointer_decode(p: Projection) -> DataFrame:
    """Version-5 chained pointers made from documents: the upper bits say where the next one is and are no part of the target; raw zero points nowhere."""
    raw = F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") * 8 + 2097152 + F.shiftleft(F.col("doc_id") % 11, 52)).otherwise(0)
    return p.table("documents").select("doc_id", pointer_target(raw, 268435456).alias("target")).where("target IS NOT NULL")


# -- pseudocode --------------------------------------------------------------------------------------------------------------------------------


LINES = "lines AS (SELECT image_id, function, unnest(string_split(pseudocode, chr(10))) AS text, unnest(range(1, len(string_split(pseudocode, chr(10))) + 1)) AS line FROM decompilation WHERE pseudocode IS NOT NULL AND plain > 0)"


@query(with_tables("decompilation", more=LINES) + "SELECT image_id, function, line::INTEGER AS line, text, false AS via_island FROM lines WHERE contains(text, 'the thing')")
def grep_lines(p: Projection) -> DataFrame:
    return grep.grep(p.decompilation, "the thing")


@query(with_tables("decompilation", more=LINES) + f"SELECT image_id, function, line::INTEGER AS line, text, false AS via_island FROM lines WHERE contains(translate(text, {LETTERS[0]}, {LETTERS[1]}), 'edble')")
def grep_ignore_case(p: Projection) -> DataFrame:
    return grep.grep(p.decompilation, "EdBle", ignore_case=True)


#: Islands that pseudocode mentions, with the symbols of their targets.
CROSSING = f"crossing AS (SELECT {ISLANDS} + (address - {BASE}) // 16 AS island, min(name) AS symbol FROM symbol GROUP BY 1)"


def crossing(p: Projection) -> DataFrame:
    return p.symbol.groupBy((ISLANDS + ((F.col("address") - BASE) / 16).cast("long")).alias("island")).agg(F.min("name").alias("symbol"))


@query(
    with_tables("decompilation", "symbol", more=f"{LINES}, {CROSSING}")
    + """SELECT image_id, function, line::INTEGER AS line, text, via_island FROM (
    SELECT image_id, function, line, text, false AS via_island FROM lines WHERE contains(text, '_1')
    UNION ALL SELECT image_id, function, line, replace(text, 'MEMORY[0x' || printf('%X', island) || ']', symbol), true FROM lines JOIN crossing ON island = ('0x' || regexp_extract(text, 'MEMORY\\[0x([0-9A-F]+)\\]', 1))::BIGINT
    WHERE contains(text, 'MEMORY[0x') AND NOT contains(text, '_1') AND contains(symbol, '_1'))"""
)
def grep_cross_image(p: Projection) -> DataFrame:
    return grep.grep(p.decompilation, "_1", crossing(p))


@query(with_tables("decompilation", "image", more=LINES) + "SELECT least(count(*), 20) AS shown, count(*) > 20 AS stopped FROM lines JOIN image USING (image_id) WHERE contains(text, 'on')")
def grep_limit_accounting(p: Projection) -> DataFrame:
    found = grep.limited(grep.grep(p.decompilation, "on"), p.image, 20).agg(F.count("*").alias("n"))
    return found.select(F.least("n", F.lit(20).cast("long")).alias("shown"), (F.col("n") > 20).alias("stopped"))


@query(with_tables("decompilation") + "SELECT count(*) FILTER (status = 'Ok') AS ok, count(*) AS attempted, coalesce(sum(len(string_split(pseudocode, chr(10)))), 0)::BIGINT AS lines, count(*) FILTER (lower(reason) LIKE '%function too big%') AS too_big, count(*) FILTER (pseudocode IS NULL OR plain = 0) AS without FROM decompilation")
def decompile_coverage(p: Projection) -> DataFrame:
    return stores.pseudocode_coverage(p.decompilation)


@query(with_tables("decompilation") + "SELECT function, status FROM decompilation WHERE pseudocode IS NULL OR plain = 0")
def without_pseudocode(p: Projection) -> DataFrame:
    return p.decompilation.where("pseudocode IS NULL OR plain = 0").select("function", "status")


@query("SELECT s_name AS store, s_suppkey % 3 <> 1 AS complete FROM supplier")
def completeness(p: Projection) -> DataFrame:
    s = p.table("supplier")
    meta = s.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("store"), F.lit("Complete").alias("key"), F.when(F.col("s_suppkey") % 3 == 1, "0").otherwise("1").alias("value"))
    return stores.complete(meta, s.select(F.col("s_name").alias("store")))


@query(with_tables("function", "decompilation") + "SELECT address AS function, image_id FROM function WHERE address NOT IN (SELECT function FROM decompilation)")
def resume_remaining(p: Projection) -> DataFrame:
    return stores.remaining(p.function.select(F.col("address").alias("function"), "image_id"), p.decompilation)


@query(with_tables("image") + "SELECT name, row_number() OVER (ORDER BY bytes, tower NULLS LAST, name) AS place FROM (SELECT name, tower, image_id % 3 AS bytes FROM image)")
def build_order(p: Projection) -> DataFrame:
    """Places in the build; there is a row for each image of the catalogue, so one task numbers them."""
    from pyspark.sql import Window as W

    work = p.image.select("name", "tower", (F.col("image_id") % 3).alias("bytes"))
    return work.select("name", F.row_number().over(W.orderBy("bytes", F.col("tower").asc_nulls_last(), "name")).cast("long").alias("place"))


@query(with_tables("image") + "SELECT name, CASE WHEN image_id % 4 = 0 THEN 'Pending' ELSE 'HexRaysDone' END AS hexrays_state FROM image")
def resume_reset(p: Projection) -> DataFrame:
    running = p.image.select("name", F.when(F.col("image_id") % 4 == 0, "HexRaysRunning").otherwise("HexRaysDone").alias("hexrays_state"))
    return stores.reset_running(running)


@query(with_tables("coverage") + "SELECT path, layer, unit, CASE WHEN image_id % 2 = 0 THEN 1 ELSE read END::BIGINT AS read, total FROM coverage JOIN image USING (path)")
def coverage_upsert(p: Projection) -> DataFrame:
    even = p.coverage.join(p.image.where("image_id % 2 = 0").select("path"), "path", "left_semi").withColumn("read", F.lit(1).cast("long"))
    return stores.upsert(p.coverage, even, ["path", "layer"])


@query("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_write(p: Projection) -> DataFrame:
    e = p.table("events").select("user_id", "event_id", "event_type")
    return stores.latest(e, ["user_id"], "event_id").select("user_id", "event_type")


@query(
    """SELECT coalesce(s.doc_id, d.doc_id)::VARCHAR AS path, CASE WHEN s.doc_id IS NULL THEN 'added' WHEN d.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS fate
    FROM (SELECT doc_id, n_chars AS size FROM documents WHERE doc_id % 11 <> 0) s FULL JOIN (SELECT doc_id, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 13 <> 0) d ON s.doc_id = d.doc_id
    WHERE s.doc_id IS NULL OR d.doc_id IS NULL OR s.size <> d.size"""
)
def staleness_diff(p: Projection) -> DataFrame:
    """File stamps made from documents: every fifth differs, some are missing on either side."""
    i, time = F.col("doc_id"), F.lit(0).cast("long").alias("mtime")
    d = p.table("documents")
    stored = d.where(i % 11 != 0).select(i.cast("string").alias("path"), F.col("n_chars").alias("size"), time)
    disk = d.where(i % 13 != 0).select(i.cast("string").alias("path"), (F.col("n_chars") + F.when(i % 5 == 0, 1).otherwise(0)).alias("size"), time)
    return stores.staleness(stored, disk)


# -- documents ---------------------------------------------------------------------------------------------------------------------------------


ADDRESSES = "SELECT DISTINCT section, ('0x' || unnest(regexp_extract_all(text, '0x(1[89a-f][0-9a-f]{7}|2[0-9a-f]{8})\\b', 1)))::BIGINT AS address FROM cited_text"


@query(with_tables("cited_text") + ADDRESSES)
def citation_addresses(p: Projection) -> DataFrame:
    return documents.citations(p.cited_text).where("address IS NOT NULL").select("section", "address")


@query(with_tables("cited_text") + "SELECT DISTINCT section, symbol FROM (SELECT section, unnest(regexp_extract_all(text, '`([^`]+)`', 1)) AS symbol FROM cited_text) WHERE symbol NOT LIKE '%.cpp'")
def citation_symbols(p: Projection) -> DataFrame:
    return documents.citations(p.cited_text).where("symbol IS NOT NULL").select("section", "symbol")


@query("SELECT doc_id AS section, CASE WHEN doc_id % 2 = 0 THEN 6442450944 + doc_id END AS address, CASE WHEN doc_id % 2 = 1 THEN 'Name' || doc_id END AS symbol FROM documents UNION ALL SELECT doc_id, 6442450944 + doc_id, NULL FROM documents")
def concept_aliases(p: Projection) -> DataFrame:
    i = F.col("doc_id")
    at = F.concat(F.lit("0x"), F.lower(F.hex(BASE + i)))
    alias = F.array(F.when(i % 2 == 0, at).otherwise(F.concat(F.lit("Name"), i.cast("string"))), F.lit("0xnothex"))
    text = F.concat(F.lit("---\ntype: concept\n---\nsee "), at, F.lit("\n<!-- generated -->\nsee 0x1ffffffff"))
    return documents.concept_citations(p.table("documents").select(i.alias("section"), alias.alias("aliases"), text.alias("text")))


@query(
    with_tables("seal_text")
    + "SELECT file, line AS first_line, text FROM seal_text"
)
def comment_blocks(p: Projection) -> DataFrame:
    """Each comment line is set apart from the next by a line of code."""
    lines = p.seal_text.select("file", "line", "text")
    spaced = lines.select("file", (F.col("line") * 2).alias("line"), "text").unionByName(lines.select("file", (F.col("line") * 2 + 1).alias("line"), F.lit("int x = 1;").alias("text")))
    return documents.comment_blocks(spaced).select("file", (F.col("first_line") / 2).cast("long").alias("first_line"), "text")


@query(
    with_tables("seal_text")
    + """SELECT file, line, 'BIN' AS tag, 'Kit' || ((line - 1) % 7) AS image, ('0x' || nullif(regexp_extract(text, 'at 0x(1[89a-f][0-9a-f]{7}|2[0-9a-f]{8})\\b', 1), ''))::BIGINT AS address FROM seal_text UNION ALL SELECT file, line, 'KIT', NULL, NULL FROM seal_text"""
)
def seal_rows(p: Projection) -> DataFrame:
    blocks = p.seal_text.select("file", F.col("line").alias("first_line"), F.regexp_replace("text", r"\[BIN (Kit[0-9])\]", r"[BIN] $1").alias("text"))
    return documents.seals(blocks, ["BIN", "KIT"], "BIN").select("file", "line", "tag", "image", "address")


CITED_AT = BASE + 37 * STEP


@query(with_tables("cited_text", "section", more=f"citation AS ({ADDRESSES})") + f"SELECT s.file, s.number, s.title, s.first_line, s.last_line FROM citation c JOIN section s ON c.section = s.id WHERE c.address = {CITED_AT}")
def cited_by(p: Projection) -> DataFrame:
    return documents.cited_by(documents.citations(p.cited_text), p.section, CITED_AT)


SEALED = "SELECT file, line, ('0x' || nullif(regexp_extract(text, 'at 0x(1[89a-f][0-9a-f]{7}|2[0-9a-f]{8})\\b', 1), ''))::BIGINT AS address FROM seal_text"


def sealed(p: Projection) -> DataFrame:
    return p.seal_text.select("file", "line", parse_hex(F.nullif(F.regexp_extract("text", f"at {documents.ADDRESS}", 1), F.lit(""))).alias("address"))


@query(with_tables("seal_text", more=f"seal AS ({SEALED})") + f"SELECT file, line FROM seal WHERE address = {CITED_AT}")
def sealed_at(p: Projection) -> DataFrame:
    return sealed(p).where(F.col("address") == CITED_AT).select("file", "line")


@query(with_tables("seal_text", more=f"seal AS ({SEALED})") + "SELECT count(*) FILTER (address = 1) AS hits, CASE WHEN count(*) FILTER (address = 1) = 0 THEN count(*) FILTER (address IS NULL) END AS blind FROM seal")
def blind_spot(p: Projection) -> DataFrame:
    return documents.blind_spot(sealed(p), 1)


@query(with_tables("section") + "SELECT file, number, title, first_line, last_line - first_line + 1 AS n_lines FROM section WHERE file LIKE '%/conv-3.md'")
def outline(p: Projection) -> DataFrame:
    return documents.outline(p.section, "conv-3")


@query(with_tables("section") + "SELECT id, title, text FROM section WHERE file = 'docs/re/conv-3.md' AND number = '1' ORDER BY id LIMIT 1")
def section_by_number(p: Projection) -> DataFrame:
    return documents.section_by_number(p.section, "docs/re/conv-3.md", "1").select("id", "title", "text")


@query(with_tables("section") + f"SELECT id, title FROM section WHERE file = 'docs/re/conv-3.md' AND contains(translate(title, {LETTERS[0]}, {LETTERS[1]}), 'ser') ORDER BY NOT contains(title, 'SER'), id LIMIT 1")
def section_by_title(p: Projection) -> DataFrame:
    return documents.section_by_title(p.section, "docs/re/conv-3.md", "SER").select("id", "title")


@query(with_tables("section") + "SELECT DISTINCT replace(file, '/re/', '/re/old/') AS file FROM section WHERE file LIKE '%/conv-3.md' UNION SELECT DISTINCT file FROM section WHERE file LIKE '%/conv-3.md'")
def ambiguous_slug(p: Projection) -> DataFrame:
    copied = p.section.unionByName(p.section.withColumn("file", F.replace("file", F.lit("/re/"), F.lit("/re/old/"))))
    return documents.files_of_slug(copied, "conv-3")


LEVEL = "SELECT 'f' || (doc_id // 50) AS file, (doc_id % 50) * 3 + 1 AS line, 1 + (doc_id * 7 + doc_id // 3) % 6 AS level FROM documents"


@query(
    f"""SELECT a.file, a.level::INTEGER AS level, a.line::INTEGER AS first_line, coalesce((SELECT min(b.line) - 1 FROM ({LEVEL}) b WHERE b.file = a.file AND b.line > a.line AND b.level <= a.level), 200)::INTEGER AS last_line FROM ({LEVEL}) a"""
)
def section_nesting(p: Projection) -> DataFrame:
    i = F.col("doc_id")
    h = p.table("documents").select(F.concat(F.lit("f"), (i / 50).cast("long").cast("string")).alias("file"), (i % 50 * 3 + 1).cast("int").alias("line"), (1 + (i * 7 + (i / 3).cast("long")) % 6).cast("int").alias("level"), F.lit(200).alias("n_lines"), F.lit(None).cast("string").alias("number"), F.lit("t").alias("title"))
    return documents.section_spans(h).select("file", "level", "first_line", "last_line")


@query(
    """SELECT 'd/' || doc_id AS file, doc_id::VARCHAR AS number, 'One' AS title, 1 AS level, 1 AS first_line, 8 AS last_line FROM documents
    UNION ALL SELECT 'd/' || doc_id, doc_id || '.1', 'Two', 2, 7, 8 FROM documents"""
)
def heading_parse(p: Projection) -> DataFrame:
    """Markdown made from documents: a numbered heading, a fenced look-alike, a nested heading."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("# §"), i, F.lit(". One\r\nbody\n```\n# no heading\n```\n    # code\n## "), i, F.lit(".1 Two\nend\n"))
    return documents.sections(p.table("documents").select(F.concat(F.lit("d/"), i).alias("file"), text.alias("text"))).select("file", "number", "title", "level", "first_line", "last_line")


FOLDED = "SELECT doc_id AS id, lower(text) AS t FROM documents"


@query(f"SELECT id FROM ({FOLDED}) WHERE contains(t, 'tion') AND contains(t, 'thing')")
def find_and(p: Projection) -> DataFrame:
    return fts.find(p.table("documents"), "tion thing", key="doc_id").select(F.col("doc_id").alias("id"))


@query(f"SELECT id FROM ({FOLDED}) WHERE contains(t, 'the thing') OR (contains(t, 'eux') AND NOT contains(t, 'pour'))")
def find_or_not(p: Projection) -> DataFrame:
    return fts.find(p.table("documents"), '"the thing" OR (eux NOT pour)', key="doc_id").select(F.col("doc_id").alias("id"))


OVERLAPS = "len(list_filter(range(1, length(t) - 3), lambda i: t[i:i + 4] = 'thing'))"


@query(
    f"""WITH d AS (SELECT id, t, greatest(length(t) - 2, 0) AS size, {OVERLAPS} AS f FROM ({FOLDED})), c AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (f > 0) AS k FROM d)
    SELECT id, round(-greatest(ln((n - k + 0.5) / (k + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS rank FROM d, c WHERE f > 0"""
)
def find_bm25(p: Projection) -> DataFrame:
    return fts.find(p.table("documents"), "thing", key="doc_id").select(F.col("doc_id").alias("id"), F.round("rank", 6).alias("rank"))


@query(
    f"""SELECT id, CASE WHEN start > 1 THEN ' ... ' ELSE '' END || substr(text, start, place - start) || '>>>' || substr(text, place, 9) || '<<<' || substr(text, place + 9, 17 - (place - start)) || CASE WHEN start + 25 < length(text) THEN ' ... ' ELSE '' END AS snippet
    FROM (SELECT *, greatest(place - 8, 1) AS start FROM (SELECT doc_id AS id, text, strpos(lower(text), 'the thing') AS place FROM documents) WHERE place > 0)"""
)
def find_snippet(p: Projection) -> DataFrame:
    return fts.find(p.table("documents"), '"the thing"', key="doc_id").select(F.col("doc_id").alias("id"), "snippet")


@query(f"SELECT id FROM ({FOLDED}) WHERE contains(t, 'ntti') AND contains(t, 'ttis')")
def trigram_candidates(p: Projection) -> DataFrame:
    """By the inverted index, then checked."""
    docs = p.table("documents").select(F.col("doc_id").alias("id"), "text")
    both = fts.candidates(fts.trigrams(docs), "ntti", "ttis")
    return docs.join(both, "id").where(F.lower("text").contains("ntti") & F.lower("text").contains("ttis")).select("id")


# -- verdicts of searches ------------------------------------------------------------------------------------------------------------------------


JUDGED = "CASE WHEN count > 0 THEN 'FOUND' WHEN read = total THEN 'EMPTY' ELSE 'PARTIAL' END AS verdict, count, read, total"
DOCUMENTS = "(SELECT coalesce(sum(read), 0)::BIGINT AS read, coalesce(sum(total), 0)::BIGINT AS total FROM document_coverage)"
ABSENT = "qqqqzzzz"


def each(parts: list[tuple[str, DataFrame]], name: str) -> DataFrame:
    out = None
    for key, df in parts:
        row = df.withColumn(name, F.lit(key))
        out = row if out is None else out.unionByName(row)
    return out


@query(with_tables("document_coverage", more=f"hits AS (SELECT 'thing' AS asked, count(*) AS count FROM ({FOLDED}) WHERE contains(t, 'thing') UNION ALL SELECT '{ABSENT}', count(*) FROM ({FOLDED}) WHERE contains(t, '{ABSENT}'))") + f"SELECT asked, {JUDGED} FROM hits, {DOCUMENTS}")
def find_verdict(p: Projection) -> DataFrame:
    """A text that stands in documents, and one that doesn't: with documents unread, the second answer is PARTIAL."""
    return each([(t, counted(fts.find(p.table("documents"), t, key="doc_id"), documents.coverage(p.document_coverage))) for t in ("thing", ABSENT)], "asked")


@query(with_tables("document_coverage", "section", more="hits AS (SELECT 'conv-3' AS asked, count(*) AS count FROM section WHERE file LIKE '%/conv-3.md' UNION ALL SELECT 'conv-none', count(*) FROM section WHERE file LIKE '%/conv-none.md')") + f"SELECT asked, {JUDGED} FROM hits, {DOCUMENTS}")
def laudo_verdict(p: Projection) -> DataFrame:
    return each([(slug, counted(documents.outline(p.section, slug), documents.coverage(p.document_coverage))) for slug in ("conv-3", "conv-none")], "asked")


#: Patterns with their limits: all hits, one that stops early, none at all.
SEARCHES = (("the thing", 0), ("on", 20), (ABSENT, 200))
SEARCH_SQL = " UNION ALL ".join(
    f"""SELECT '{pattern}' AS asked, CASE WHEN count > 0 THEN 'FOUND' WHEN searched = selected THEN 'EMPTY' ELSE 'PARTIAL' END AS verdict, count, * EXCLUDE (count) FROM
    (SELECT CASE WHEN {limit} > 0 THEN least(count(*), {limit}) ELSE count(*) END AS count FROM hits WHERE contains(text, '{pattern}')),
    (SELECT count(*) AS selected, count(*) FILTER (fate = 's') AS searched, count(*) FILTER (fate = 'n') AS not_searched, count(*) FILTER (fate = 'r') AS not_reached, count(*) FILTER (fate = 's' AND image_id % 4 = 0) AS partial,
        count(*) FILTER (fate = 's' AND image_id NOT IN (SELECT image_id FROM call)) AS unindexed, coalesce(sum(functions) FILTER (fate = 's'), 0)::BIGINT AS functions, coalesce(sum(refused) FILTER (fate = 's'), 0)::BIGINT AS refused
     FROM (SELECT *, CASE WHEN path > (SELECT path FROM (SELECT path, row_number() OVER (ORDER BY path, function, line) AS k FROM hits WHERE contains(text, '{pattern}')) WHERE {limit} > 0 AND k = {limit} + 1) THEN 'r' WHEN functions IS NULL THEN 'n' ELSE 's' END AS fate
        FROM image LEFT JOIN (SELECT image_id, count(*) AS functions, count(*) FILTER (pseudocode IS NULL OR plain = 0) AS refused FROM decompilation GROUP BY image_id) USING (image_id)))"""
    for pattern, limit in SEARCHES
)


@query(with_tables("decompilation", "image", "call", more=f"{LINES}, hits AS (SELECT * FROM lines JOIN image USING (image_id))") + SEARCH_SQL)
def grep_verdict(p: Projection) -> DataFrame:
    """What a search answers and how much of the images it looked at: those without pseudocode, those after the hit that stopped it, those in part."""
    parts = []
    for pattern, limit in SEARCHES:
        hits = grep.limited(grep.grep(p.decompilation, pattern), p.image, limit)
        last = hits.offset(limit).first() if limit else None  # the hit beyond the limit
        seen = grep.accounting(grep.searched(p.image, p.decompilation.join(p.image.select("image_id"), "image_id", "left_semi"), p.call, p.partial, last["path"] if last else None))
        n = hits.agg(F.count("*").alias("count"))
        row = (n.select(F.least("count", F.lit(limit).cast("long")).alias("count")) if limit else n).join(F.broadcast(seen), F.lit(True))
        parts.append((pattern, row.withColumn("verdict", judged(F.col("count"), F.col("searched"), F.col("selected")))))
    return each(parts, "asked")


# -- composite -----------------------------------------------------------------------------------------------------------------------------------


@query(
    with_tables("call", "function", "segment", "symbol", "seal_text", more=f"seal AS ({SEALED})")
    + f"""SELECT 'owner' AS block, path AS text, NULL::BIGINT AS number FROM segment WHERE name <> '__LINKEDIT' AND {PLACE} >= address AND {PLACE} < address + size
    UNION ALL SELECT 'function', NULL, address FROM function WHERE {PLACE} >= address AND {PLACE} < address + size
    UNION ALL SELECT 'symbol', min(name), NULL FROM symbol WHERE address = {PLACE} HAVING count(*) > 0
    UNION ALL SELECT 'callee', via, target FROM call WHERE caller = {PLACE}
    UNION ALL SELECT 'caller', via, site FROM call JOIN image USING (image_id) WHERE target = {PLACE} AND facts_state = 'FactsDone'
    UNION ALL SELECT 'sealed', file, line FROM seal WHERE address = {PLACE}"""
)
def q_composite(p: Projection) -> DataFrame:
    """All that is known of one address, block by block."""
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    at = p.spark.createDataFrame([(PLACE,)], "at long")
    owner = lookup.owners(at, p.segment).where("path IS NOT NULL").select(F.lit("owner").alias("block"), F.col("path").alias("text"), none.alias("number"))
    image_id = (PLACE - BASE) // (IMAGE * STEP)
    function = p.function.where((F.col("image_id") == image_id) & (F.col("address") <= PLACE)).orderBy(F.desc("address")).limit(1).where(F.col("address") + F.col("size") > PLACE)
    blocks = [
        function.select(F.lit("function"), text, "address"),
        p.symbol.where(F.col("address") == PLACE).groupBy().agg(F.min("name").alias("name")).where("name IS NOT NULL").select(F.lit("symbol"), "name", none),
        lookup.callees(p.calls(caller=PLACE), PLACE).select(F.lit("callee"), "via", "target"),
        lookup.callers(p.calls(PLACE), p.image, PLACE).select(F.lit("caller"), "via", "site"),
        sealed(p).where(F.col("address") == PLACE).select(F.lit("sealed"), "file", "line"),
    ]
    for b in blocks:
        owner = owner.union(b)
    return owner


# -- single questions ----------------------------------------------------------------------------------------------------------------------------


SMALLEST = "(SELECT min(p_name || '_' || p_partkey) FROM part)"


@query(
    with_tables("symbol", "image", "segment", "function", more=f"""at AS (SELECT address AS place FROM (SELECT image_id, address FROM symbol WHERE name = {SMALLEST} UNION SELECT image_id, address FROM symbol WHERE demangled = {SMALLEST}) JOIN image USING (image_id) WHERE facts_state = 'FactsDone' ORDER BY path, address LIMIT 1)""".replace("at AS", "asked AS"))
    + """SELECT 'address' AS block, NULL AS text, place AS number FROM asked
    UNION ALL SELECT 'owner', path, NULL FROM asked JOIN segment ON name <> '__LINKEDIT' AND place >= address AND place < address + size
    UNION ALL SELECT 'function', NULL, address FROM asked JOIN function ON place >= address AND place < address + size"""
)
def q_symbol(p: Projection) -> DataFrame:
    """A question by symbol: its address, owner and function."""
    name = p.table("part").agg(F.min(F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")))).first()[0]
    asked = lookup.symbol_addresses(p.symbol, p.image, name).select(F.col("address").alias("place"))
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    owner = lookup.owners(asked, p.segment, "place").where("path IS NOT NULL").select(F.lit("owner"), "path", none)
    held = range_join(asked, p.function, "place", "address", "size").select(F.lit("function"), text, "address")
    return asked.select(F.lit("address").alias("block"), text.alias("text"), F.col("place").alias("number")).union(owner).union(held)


@query(
    with_tables("function", "image", more=f"probe AS ({PROBES})")
    + """SELECT address_of, path, address, size FROM (SELECT p.address_of, i.path, f.address, f.size, row_number() OVER (PARTITION BY p.address_of ORDER BY i.path, f.address DESC) AS k
    FROM (SELECT DISTINCT address_of FROM probe) p JOIN function f ON f.size > 0 AND p.address_of >= f.address AND p.address_of < f.address + f.size JOIN image i USING (image_id) WHERE facts_state = 'FactsDone') WHERE k = 1"""
)
def first_containing_image(p: Projection) -> DataFrame:
    probe = p.table("documents").select((BASE - 512 + F.col("doc_id") * 389).alias("address_of")).distinct()
    return lookup.first_containing(probe, p.function, p.image)


@query(
    with_tables("cited_text", "section", "seal_text", more=f"citation AS ({ADDRESSES}), seal AS ({SEALED})")
    + " UNION ALL ".join(
        f"SELECT '{name}' AS block, {at} AS address, count(*) AS count, CASE WHEN count(*) = 0 THEN ({blind}) END AS blind FROM {rows} WHERE address = {at}"
        for at in (CITED_AT, 1)
        for name, rows, blind in (("cited by", "citation JOIN section ON section = id", "SELECT 0"), ("sealed at", "seal", "SELECT count(*) FROM seal WHERE address IS NULL"))
    )
)
def layer3_block(p: Projection) -> DataFrame:
    """Counts of an address's citations and seals, and the blind spot where there are none; citations of the projection all have an address."""
    citation = documents.citations(p.cited_text).where("address IS NOT NULL")
    parts = []
    for at in (CITED_AT, 1):
        for name, rows, every in (("cited by", documents.cited_by(citation, p.section, at), citation), ("sealed at", sealed(p).where(F.col("address") == at), sealed(p))):
            one_row = rows.agg(F.count("*").alias("count")).join(documents.blind_spot(every, at).select("blind"), F.lit(True))
            parts.append((name, one_row.select(F.lit(at).cast("long").alias("address"), "count", F.when(F.col("count") == 0, F.coalesce("blind", F.lit(0).cast("long"))).alias("blind"))))
    out = None
    for name, df in parts:
        row = df.withColumn("block", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    with_tables("image", "coverage", "decompilation", "section", "cited_text", "seal_text")
    + """SELECT 'image' AS block, path AS text, coalesce(read, 0) AS read, coalesce(total, 0) AS total FROM image LEFT JOIN coverage USING (path)
    UNION ALL SELECT 'pseudocode', NULL, count(*) FILTER (status = 'Ok'), count(*) FROM decompilation UNION ALL SELECT 'done', NULL, count(*) FILTER (facts_state = 'FactsDone'), count(*) FROM image
    UNION ALL SELECT 'section', NULL, count(*), count(*) FROM section UNION ALL SELECT 'cited', NULL, count(*), count(*) FROM cited_text UNION ALL SELECT 'sealed', NULL, count(*), count(*) FROM seal_text"""
)
def status_rows(p: Projection) -> DataFrame:
    """What status says: state of images, pseudocode and documents."""
    text = F.lit(None).cast("string")
    rows = lookup.image_coverage(p.image, p.coverage).select(F.lit("image").alias("block"), F.col("path").alias("text"), "read", "total")
    rows = rows.union(stores.pseudocode_coverage(p.decompilation).select(F.lit("pseudocode"), text, "ok", "attempted"))
    rows = rows.union(p.image.agg(F.count_if(F.col("facts_state") == "FactsDone").alias("done"), F.count("*").alias("n")).select(F.lit("done"), text, "done", "n"))
    for name, df in (("section", p.section), ("cited", p.cited_text), ("sealed", p.seal_text)):
        rows = rows.union(df.agg(F.count("*").alias("n")).select(F.lit(name), text, "n", F.col("n").alias("m")))
    return rows


@query(with_tables("decompilation") + f"SELECT function, pseudocode FROM decompilation WHERE function = {PLACE} AND pseudocode IS NOT NULL")
def pseudocode_of(p: Projection) -> DataFrame:
    return p.decompilation.where((F.col("function") == PLACE) & F.col("pseudocode").isNotNull()).select("function", "pseudocode")


@query(with_tables("decompilation") + "SELECT function, length(pseudocode) AS size FROM decompilation WHERE pseudocode IS NOT NULL AND plain > 0")
def pseudocode_scan(p: Projection) -> DataFrame:
    return p.decompilation.where("pseudocode IS NOT NULL AND plain > 0").select("function", F.length("pseudocode").cast("long").alias("size"))


WANTED = ("Supplier#000000000", "Supplier#000000003", "no such image")
WANTED_SQL = "wanted AS (SELECT unnest(['" + "', '".join(WANTED) + "']) AS name)"


@query(with_tables("image", more=WANTED_SQL) + "SELECT coalesce(i.path, w.name) AS path, i.path IS NOT NULL AS chosen FROM wanted w LEFT JOIN image i ON split_part(i.path, '/', -1) = w.name")
def image_selection(p: Projection) -> DataFrame:
    """Images chosen by basename, and the names that no image has."""
    chosen, unknown = grep.selected_images(p.image, list(WANTED))
    return chosen.select("path", F.lit(True).alias("chosen")).union(p.spark.createDataFrame([(n, False) for n in unknown], "path string, chosen boolean"))


@query("SELECT s_suppkey % 7 * 4096 AS address, 4096 * (1 + s_suppkey % 2) AS size, min(s_name) AS file FROM supplier GROUP BY ALL")
def mapping_dedupe(p: Projection) -> DataFrame:
    """Mappings that several files list are one."""
    s = p.table("supplier").select((F.col("s_suppkey") % 7 * 4096).alias("address"), (4096 * (1 + F.col("s_suppkey") % 2)).alias("size"), F.col("s_name").alias("file"))
    return s.groupBy("address", "size").agg(F.min("file").alias("file"))


@query(with_tables("section") + "SELECT s.id, d.doc_id IS NULL OR d.doc_id % 5 = 0 AS stale FROM section s LEFT JOIN documents d ON d.doc_id = s.id // 1000 WHERE contains(lower(s.text), 'the')")
def find_stale(p: Projection) -> DataFrame:
    """Hits with their mark: a file whose stamp differs, or that is gone, is stale."""
    hits = fts.find(p.section, "the").join(p.section.select("id", "file"), "id")
    conversation = (F.col("id") / 1000).cast("long")
    stored = p.section.select(F.col("file").alias("path"), conversation.alias("size"), F.lit(0).alias("mtime")).distinct()
    disk = p.table("documents").select(F.concat(F.lit("docs/re/conv-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), (F.col("doc_id") + (F.col("doc_id") % 5 == 0).cast("int")).alias("size"), F.lit(0).alias("mtime"))
    changed = stores.staleness(stored, disk).where("fate <> 'added'").select(F.col("path").alias("file"), F.lit(True).alias("stale"))
    return hits.join(changed, "file", "left").select("id", F.coalesce("stale", F.lit(False)).alias("stale"))


@query(
    with_tables("coverage", more="""built AS (SELECT path, CASE WHEN image_id % 3 = 0 THEN 'FactsFailed' ELSE 'FactsDone' END AS facts_state, CASE WHEN image_id % 3 = 0 THEN 'broken' END AS reason, 7::BIGINT AS read, 8::BIGINT AS total FROM image WHERE image_id % 2 = 0),
    counts AS (SELECT * FROM built WHERE facts_state <> 'FactsFailed' OR path NOT IN (SELECT path FROM image JOIN coverage USING (path) WHERE facts_state = 'FactsDone'))""")
    + """SELECT path, coalesce(c.facts_state, i.facts_state) AS facts_state, c.reason, CASE WHEN c.path IS NULL THEN v.read WHEN c.facts_state = 'FactsDone' THEN c.read END AS read
    FROM image i LEFT JOIN counts c USING (path) LEFT JOIN coverage v USING (path)"""
)
def build_recorded(p: Projection) -> DataFrame:
    """A build of every other image, of which some fail: what the catalogue says then."""
    i = F.col("image_id")
    failed = i % 3 == 0
    built = p.image.where(i % 2 == 0).select("path", F.when(failed, "FactsFailed").otherwise("FactsDone").alias("facts_state"), F.when(failed, "broken").alias("reason"), F.lit(7).cast("long").alias("read"), F.lit(8).cast("long").alias("total"))
    image, coverage = stores.recorded(p.image.withColumn("reason", F.lit(None).cast("string")), p.coverage, built)
    return image.join(coverage.select("path", "read"), "path", "left").select("path", "facts_state", "reason", "read")


# -- parsers on projected input ------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey % 10 AS image_id, p_partkey * 16 AS address, p_name AS name, (p_partkey * 7 % 256) & 1 AS external FROM part
    WHERE ((p_partkey * 7 % 256) & 224) = 0 AND ((p_partkey * 7 % 256) & 14) = 14 AND p_partkey % 11 > 0"""
)
def symbol_filter(p: Projection) -> DataFrame:
    """Raw symbol entries made from parts: debugging ones, undefined ones and those at zero go."""
    i = F.col("p_partkey")
    raw = p.table("part").select((i % 10).alias("image_id"), F.col("p_name").alias("name"), (i * 7 % 256).cast("int").alias("type"), F.when(i % 11 > 0, i * 16).otherwise(0).alias("value"))
    return binary.filtered_symbols(raw).withColumn("external", F.col("external").cast("long"))


@query("SELECT s_suppkey AS image_id, (s_suppkey * 65536 + sum(d) OVER (PARTITION BY s_suppkey ORDER BY k))::BIGINT AS address FROM (SELECT s_suppkey, k, 1 + (k * 37 + s_suppkey) % 300 AS d FROM (SELECT s_suppkey, unnest(range(1, 41)) AS k FROM supplier))")
def function_starts(p: Projection) -> DataFrame:
    """Deltas in ULEB128, of one byte below 128 and two from there, then a zero."""
    def coded(k):
        d = 1 + (k * 37 + F.col("s_suppkey")) % 300
        byte = lambda c: F.lpad(F.hex(c), 2, "0")
        return F.when(d < 128, byte(d)).otherwise(F.concat(byte(d % 128 + 128), byte(F.floor(d / 128))))

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), coded), "")
    return binary.function_starts(p.table("supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") * 65536).alias("base"), F.unhex(F.concat(text, F.lit("00FF"))).alias("bytes")))


#: Islands are the documents; each jumps on to another until a number that a segment owns.
NEXT_SQL, OWNED_FROM = "(doc_id * 7 + 3) % (SELECT count(*) FROM documents) + CASE WHEN doc_id % 4 = 0 THEN 1000000 ELSE 0 END", 1_000_000


@query(
    f"""WITH RECURSIVE hop AS (SELECT doc_id AS island, {NEXT_SQL} AS next FROM documents WHERE doc_id % 9 > 0),
    walk AS (SELECT island, next AS place, [island, next] AS seen, 1 AS hops FROM hop WHERE next <> island UNION ALL SELECT w.island, h.next, list_append(seen, h.next), hops + 1 FROM walk w JOIN hop h ON h.island = w.place WHERE w.place < {OWNED_FROM} AND hops < 8 AND NOT list_contains(seen, h.next))
    SELECT doc_id AS island, place AS target FROM documents LEFT JOIN (SELECT island, place FROM walk WHERE place >= {OWNED_FROM}) ON island = doc_id"""
)
def island_hops(p: Projection) -> DataFrame:
    i = F.col("doc_id")
    n = p.table("documents").count()
    following = (i * 7 + 3) % n + F.when(i % 4 == 0, OWNED_FROM).otherwise(0)
    hop = p.table("documents").where(i % 9 > 0).select(i.alias("island"), following.cast("long").alias("next"))
    owned = p.spark.range(1).select(F.lit(OWNED_FROM).cast("long").alias("address"), F.lit(1 << 20).cast("long").alias("size"))
    return binary.resolve(p.table("documents").select(i.alias("island")), hop, owned)


@query(
    """SELECT 'c/' || doc_id AS file, 'concept' AS type, CASE WHEN doc_id % 3 > 0 THEN 'Title ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id || '|Other' ELSE '' END AS aliases, doc_id % 5 > 0 AS closed FROM documents WHERE doc_id % 7 > 0 AND doc_id % 5 > 0
    UNION ALL SELECT 'c/' || doc_id, NULL, NULL, '', doc_id % 7 = 0 FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0"""
)
def front_matter(p: Projection) -> DataFrame:
    """Front matter made from documents: none for every seventh, one that does not end for every fifth, repeated keys, inline aliases for even ones."""
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    title = F.when(i % 3 > 0, F.concat(F.lit("title: first\ntitle:  Title "), n, F.lit(" \n"))).otherwise("")
    alias = F.when(i % 2 == 0, F.concat(F.lit("aliases: [a"), n, F.lit(", \"Other\", ]\n"))).otherwise("aliases:\n  - block\n")
    end = F.when(i % 5 > 0, "---\n").otherwise("")
    text = F.when(i % 7 == 0, "prose\n").otherwise(F.concat(F.lit("---\ntype: concept\n"), title, alias, end, F.lit("prose\n")))
    rows = documents.front_matter(p.table("documents").select(F.concat(F.lit("c/"), n).alias("file"), text.alias("text")))
    whole = F.col("closed")
    return rows.select("file", F.when(whole, F.col("type")).alias("type"), F.when(whole, F.col("title")).alias("title"), F.when(whole, F.coalesce(F.array_join("aliases", "|"), F.lit(""))).otherwise("").alias("aliases"), "closed")


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::VARCHAR || 'b' ELSE s_suppkey::VARCHAR || '.1' END AS bare, s_suppkey % 3 <> 0 AS numeric, (s_suppkey * 4097 >> 4) & 255 AS byte,
    CASE WHEN (s_suppkey * 37 % 512) >= 256 THEN s_suppkey * 37 % 512 - 512 ELSE s_suppkey * 37 % 512 END AS signed, 'MEMORY[0x' || printf('%X', s_suppkey * 4096) || ']' AS placeholder FROM supplier"""
)
def scalar_functions(p: Projection) -> DataFrame:
    """A section sign goes, numbers of sections are told from titles, bits and signed bits of words, placeholders."""
    i = F.col("s_suppkey")
    number = F.concat(i.cast("string"), F.when(i % 3 == 0, "b").otherwise(".1"))
    bare = text_functions.without_section_sign(F.concat(F.when(i % 2 == 0, "\u00a7").otherwise(""), number))
    return p.table("supplier").select(
        "s_suppkey", bare.alias("bare"), text_functions.looks_numeric(bare).alias("numeric"), bits(i * 4097, 4, 8).alias("byte"), text_functions.sign_extend(i * 37 % 512, 9).alias("signed"), text_functions.placeholder(i * 4096).alias("placeholder")
    )


@query(
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'bl' WHEN 1 THEN 'movk' WHEN 2 THEN 'ret' ELSE 'add' END AS mnemonic,
    CASE doc_id % 4 WHEN 0 THEN '#0x' || printf('%x', {BASE} + doc_id * 4 + (doc_id % 5000) * 4) WHEN 1 THEN 'x' || (doc_id % 31) || ', #0x' || printf('%x', doc_id % 65536) || ', lsl #48' WHEN 2 THEN ''
        ELSE 'x' || (doc_id % 31) || ', x' || (doc_id % 29) || ', #0x' || printf('%x', doc_id % 4096) END AS operands FROM documents WHERE doc_id % 8 < 7"""
)
def word_decode(p: Projection) -> DataFrame:
    """Machine words made from documents and decoded; every eighth is no instruction that the trackers need, and is skipped."""
    i = F.col("doc_id")
    word = (
        F.when(i % 8 == 7, 0).when(i % 4 == 0, 0x94000000 + i % 5000).when(i % 4 == 1, 0xF2E00000 + i % 65536 * 32 + i % 31).when(i % 4 == 2, F.lit(0xD65F03C0)).otherwise(0x91000000 + i % 4096 * 1024 + i % 29 * 32 + i % 31)
    )
    words = p.table("documents").select(i.alias("image_id"), (BASE + i * 4).alias("va"), word.cast("long").alias("word"))
    return binary.disassemble(words).select(F.col("image_id").alias("doc_id"), "mnemonic", "operands")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: one(name) for name in _QUERIES}
