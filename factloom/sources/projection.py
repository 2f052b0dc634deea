"""The fact model projected from the benchmark tables, by arithmetic that Spark and DuckDB both evaluate.

Each table is a method of Projection; TABLES has the same rule as SQL for the oracles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.asof import asof_floor
from factloom.session import importable

BASE, DATA, LINKEDIT, ISLANDS = 0x180000000, 0x270000000, 0x290000000, 0x180000000 + 0x80000000
#: Orders of an image, bytes of an order.
IMAGE, STEP = 1000, 256
#: Bytes of a document's code.
CODE = 24
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


class Projection:
    def __init__(self, spark: SparkSession, sf_dir: str):
        importable(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n(self) -> int:
        """Number of orders; a count from Parquet metadata."""
        return self.table("orders").count()

    @cached_property
    def image(self) -> DataFrame:
        s = self.table("supplier").where(F.col("s_suppkey") * IMAGE < self.n)
        j = s.join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return j.select(
            F.col("s_suppkey").alias("image_id"), F.concat(F.lit("/System/Library/"), "n_name", F.lit("/"), "s_name").alias("path"), F.concat("s_name", F.lit(".db")).alias("name"),
            F.when(F.col("s_suppkey") % 5 != 4, F.col("r_name")).alias("tower"), (BASE + F.col("s_suppkey") * IMAGE * STEP).alias("header"),
            F.when(F.col("s_suppkey") % 7 == 6, "FactsFailed").otherwise("FactsDone").alias("facts_state"),
        )

    @cached_property
    def coverage(self) -> DataFrame:
        """Read and total words of each image but every ninth."""
        i = F.col("image_id")
        return self.image.where(i % 9 != 8).select("path", F.lit("Facts").alias("layer"), F.lit("instructions").alias("unit"), F.when(i % 4 == 3, 63000).otherwise(64000).cast("long").alias("read"), F.lit(64000).cast("long").alias("total"))

    @cached_property
    def segment(self) -> DataFrame:
        parts = F.array(
            F.struct(F.lit("__TEXT").alias("name"), (BASE + F.col("image_id") * IMAGE * STEP).alias("address"), F.lit(IMAGE * STEP).cast("long").alias("size")),
            F.struct(F.lit("__DATA").alias("name"), (DATA + F.col("image_id") * 65536).alias("address"), F.lit(65536).cast("long").alias("size")),
            F.struct(F.lit("__LINKEDIT").alias("name"), F.lit(LINKEDIT).cast("long").alias("address"), F.lit(1 << 20).cast("long").alias("size")),
        )
        return self.image.select("image_id", "path", F.explode(parts).alias("s")).select("image_id", "path", "s.*")

    @cached_property
    def function(self) -> DataFrame:
        o = self.table("orders").where(F.col("o_orderkey") % 4 != 3)
        starts = o.select((F.col("o_orderkey") / IMAGE).cast("long").alias("image_id"), (BASE + F.col("o_orderkey") * STEP).cast("long").alias("address"))
        after = F.lead("address").over(W.partitionBy("image_id").orderBy("address"))
        text_end = BASE + (F.col("image_id") + 1) * IMAGE * STEP
        return starts.select("image_id", "address", (F.coalesce(after, text_end) - F.col("address")).alias("size"), F.lit("FunctionStarts").alias("source"))

    @cached_property
    def line(self) -> DataFrame:
        return self.lines()

    def lines(self, only=None) -> DataFrame:
        """Lines with their site: the place within the order decides. only: a condition on lines; other orders than those with such a line are left out before they are numbered."""
        l = self.table("lineitem")
        if only is not None:
            l = l.join(l.where(only).select("l_orderkey").distinct(), "l_orderkey", "left_semi")
        rank = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
        return l.withColumn("site", BASE + F.col("l_orderkey") * STEP + 4 * rank).withColumn("image_id", (F.col("l_orderkey") / IMAGE).cast("long"))

    @cached_property
    def call(self) -> DataFrame:
        return self.calls()

    def calls(self, target: int | None = None, caller: int | None = None) -> DataFrame:
        """Call rows; target: of that one alone, found in the lines before their callers are looked up; caller: those of the orders that its function may span (at most every other order has none)."""
        offset = (F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % self.n * STEP
        same = (F.col("offset") / (IMAGE * STEP)).cast("long") == F.col("image_id")
        via = F.when(same, "Direct").when(F.col("l_returnflag") == "R", "Unresolved").otherwise("Island")
        if caller is not None:
            lines = self.lines(F.col("l_orderkey").between((caller - BASE) // STEP, (caller - BASE) // STEP + 1))
        else:
            lines = self.line if target is None else self.lines((offset == target - BASE) & (F.col("l_linestatus") == "F"))
        lines = lines.where(F.col("l_linestatus") == "F").withColumn("offset", offset)
        sites = (lines if target is None else lines.where(F.col("offset") == target - BASE)).select(
            "image_id", "site", (BASE + F.col("offset")).alias("target"), via.alias("via"),
            F.when(via == "Island", ISLANDS + (F.col("offset") / 16).cast("long")).when(via == "Unresolved", BASE + F.col("offset")).alias("island"),
        )
        found = asof_floor(sites, self.function.select("image_id", "address"), ["image_id"], "site", "address")
        return found.select("image_id", "site", F.coalesce("address", F.lit(0).cast("long")).alias("caller"), "target", "island", "via")

    @cached_property
    def literal(self) -> DataFrame:
        kind = F.element_at(F.array(F.lit("add"), F.lit("ldr"), F.lit("ldur")), (F.col("l_linenumber") % 3 + 1).cast("int"))
        refs = self.line.where(F.col("l_linestatus") == "O")
        return refs.select("image_id", "site", (DATA + F.col("l_partkey") * 8).alias("target"), kind.alias("kind"), F.when((kind != "add") & (F.col("l_discount") > 0.05), F.col("l_extendedprice")).alias("value"))

    @cached_property
    def symbol(self) -> DataFrame:
        at = F.col("p_partkey") * 7 % self.n
        return self.table("part").select((at / IMAGE).cast("long").alias("image_id"), (BASE + at * STEP).alias("address"), F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("demangled"), (F.col("p_size") % 2).alias("external"))

    @cached_property
    def instr(self) -> DataFrame:
        """Six instructions for each document: a page, an addition or a call, two loads, a constant, and an ending."""
        i, at = F.col("doc_id"), BASE + F.col("doc_id") * CODE
        reg = F.concat(F.lit("x"), (8 + i % 3).cast("string"))
        hexed = lambda c: F.concat(F.lit("#0x"), F.lower(F.hex(c)))
        target = BASE + i * 53 % 4000 * CODE
        rows = (
            (F.lit("adrp"), F.concat(reg, F.lit(", "), hexed(DATA + i % 50 * 4096))),
            (F.when(i % 4 == 0, "bl").otherwise("add"), F.when(i % 4 == 0, hexed(target)).otherwise(F.concat(F.lit("x11, "), reg, F.lit(", "), hexed(i % 64 * 8)))),
            (F.when(i % 6 == 0, "str").otherwise("ldr"), F.concat(F.when(i % 2 == 0, "d0").otherwise(reg), F.lit(", ["), reg, F.lit(", "), hexed(i % 9 * 8), F.lit("]"))),
            (F.lit("ldr"), F.concat(F.lit("x12, [x16, "), hexed(i % 16 * 8), F.lit("]"))),
            (F.when(i % 5 == 0, "mov").otherwise("movk"), F.when(i % 5 == 0, "x12, x19").otherwise(F.concat(F.lit("x17, "), hexed(1 + i % 999), F.lit(", lsl #48")))),
            (F.when(i % 7 == 0, "ret").when(i % 7 < 4, "blraa").otherwise("cmp"), F.when(i % 7 == 0, "").when(i % 7 < 4, "x12, x17").otherwise("x12, x13")),
        )
        listed = F.array(*[F.struct((at + 4 * k).alias("va"), m.alias("mnemonic"), o.alias("operands")) for k, (m, o) in enumerate(rows)])
        return self.table("documents").select((i / IMAGE).cast("long").alias("image_id"), F.explode(listed).alias("c")).select("image_id", "c.*")

    @cached_property
    def code_function(self) -> DataFrame:
        """A function for every third document's code."""
        return self.table("documents").where("doc_id % 3 = 0").select((F.col("doc_id") / IMAGE).cast("long").alias("image_id"), (BASE + F.col("doc_id") * CODE).alias("address"))

    @cached_property
    def virtual_call(self) -> DataFrame:
        p = self.table("part")
        b = p.where(F.col("p_partkey") % 50 == 0).select(F.col("p_brand"), (BASE + F.col("p_partkey") * 7 % self.n * STEP).alias("candidate"), F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")).alias("candidate_symbol"))
        a = p.select("p_brand", (BASE + F.col("p_partkey") * 7 % self.n * STEP + 4).alias("site"), (8 * (F.col("p_size") % 16)).cast("long").alias("slot_offset"), (1 + F.col("p_partkey") % 65535).alias("discriminator"))
        return a.join(b, "p_brand").select("site", "slot_offset", "discriminator", "candidate", "candidate_symbol", F.lit("vcall-pac-v1").alias("resolver"))

    @cached_property
    def decompilation(self) -> DataFrame:
        d = self.table("documents")
        mark = F.concat(F.lit("MEMORY[0x"), F.hex(ISLANDS + F.col("doc_id") * 16), F.lit("]"))
        failed = F.col("n_chars") < 50
        return d.select(
            (F.col("doc_id") / IMAGE).cast("long").alias("image_id"), (BASE + F.col("doc_id") * STEP).alias("function"),
            F.when(~failed, F.concat("text", F.lit("\nreturn "), mark)).alias("pseudocode"), F.when(failed, 0).otherwise(F.col("n_chars")).cast("long").alias("plain"), F.when(failed, "Failed").otherwise("Ok").alias("status"),
            F.when(failed, F.when(F.col("doc_id") % 2 == 0, "Function too big (2 MB)").otherwise("no reason")).alias("reason"),
        )

    @cached_property
    def partial(self) -> DataFrame:
        """Every fourth image's pseudocode store is not complete."""
        return self.image.where("image_id % 4 = 0").select("image_id")

    @cached_property
    def document_coverage(self) -> DataFrame:
        """(root, read, total): documents by source, of which those with a label were read."""
        known = self.table("labels").select("doc_id").distinct().withColumn("known", F.lit(1))
        return self.table("documents").select("doc_id", "source").join(known, "doc_id", "left").groupBy(F.col("source").alias("root")).agg(F.count("known").alias("read"), F.count("*").alias("total"))

    @cached_property
    def section(self) -> DataFrame:
        c = self.table("conversations")
        first = F.col("turn") * 10 + 1
        return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("docs/re/conv-"), F.col("conv_id").cast("string"), F.lit(".md")).alias("file"), F.col("turn").cast("string").alias("number"), F.col("role").alias("title"), first.alias("first_line"), (first + 9).alias("last_line"), "text")

    @cached_property
    def cited_text(self) -> DataFrame:
        """Prose of a section for each document: an address, a symbol, a file name, a short number."""
        i = F.col("doc_id")
        at = F.lower(F.hex(BASE + i * 37 % self.n * STEP))
        return self.table("documents").select(i.alias("section"), F.concat(F.lit("see 0x"), at, F.lit(" and `_$sFoo"), (i % 97).cast("string"), F.lit("` or `A.b"), (i % 13).cast("string"), F.lit("` in `main.cpp` at 0x12, again 0x"), at).alias("text"))

    @cached_property
    def seal_text(self) -> DataFrame:
        """A comment line for each document: [BIN image] with an address for two in three."""
        i = F.col("doc_id")
        return self.table("documents").select(
            F.concat(F.lit("src/"), F.col("source"), F.lit(".h")).alias("file"), (i + 1).alias("line"),
            F.concat(F.lit("// [BIN Kit"), (i % 7).cast("string"), F.lit("] "), F.when(i % 3 == 0, F.lit("no place")).otherwise(F.concat(F.lit("at 0x"), F.lower(F.hex(BASE + i * 37 % self.n * STEP)))), F.lit(" [KIT] seen")).alias("text"),
        )


#: The same tables in DuckDB's SQL, in an order in which each uses earlier ones only.
TABLES: dict[str, str] = {
    "n": "SELECT count(*)::BIGINT AS n FROM orders",
    "image": f"""SELECT s_suppkey AS image_id, '/System/Library/' || n_name || '/' || s_name AS path, s_name || '.db' AS name, CASE WHEN s_suppkey % 5 <> 4 THEN r_name END AS tower,
        {BASE} + s_suppkey * {IMAGE * STEP} AS header, CASE WHEN s_suppkey % 7 = 6 THEN 'FactsFailed' ELSE 'FactsDone' END AS facts_state
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey * {IMAGE} < (SELECT n FROM n)""",
    "coverage": "SELECT path, 'Facts' AS layer, 'instructions' AS unit, CASE WHEN image_id % 4 = 3 THEN 63000 ELSE 64000 END::BIGINT AS read, 64000::BIGINT AS total FROM image WHERE image_id % 9 <> 8",
    "segment": f"""SELECT image_id, path, '__TEXT' AS name, {BASE} + image_id * {IMAGE * STEP} AS address, {IMAGE * STEP}::BIGINT AS size FROM image
        UNION ALL SELECT image_id, path, '__DATA', {DATA} + image_id * 65536, 65536 FROM image UNION ALL SELECT image_id, path, '__LINKEDIT', {LINKEDIT}, {1 << 20} FROM image""",
    "function": f"""SELECT image_id, address, coalesce(lead(address) OVER (PARTITION BY image_id ORDER BY address), {BASE} + (image_id + 1) * {IMAGE * STEP}) - address AS size, 'FunctionStarts' AS source
        FROM (SELECT (o_orderkey // {IMAGE})::BIGINT AS image_id, ({BASE} + o_orderkey * {STEP}::BIGINT)::BIGINT AS address FROM orders WHERE o_orderkey % 4 <> 3)""",
    "line": f"SELECT *, ({BASE} + l_orderkey * {STEP} + 4 * row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}))::BIGINT AS site, (l_orderkey // {IMAGE})::BIGINT AS image_id FROM lineitem",
    "call": f"""SELECT s.image_id, s.site, coalesce(f.address, 0) AS caller, {BASE} + s.o AS target, CASE via WHEN 'Island' THEN {ISLANDS} + s.o // 16 WHEN 'Unresolved' THEN {BASE} + s.o END AS island, via
        FROM (SELECT *, CASE WHEN o // {IMAGE * STEP} = image_id THEN 'Direct' WHEN l_returnflag = 'R' THEN 'Unresolved' ELSE 'Island' END AS via
            FROM (SELECT image_id, site, l_returnflag, ((l_partkey * 31 + l_suppkey * 17) % (SELECT n FROM n) * {STEP})::BIGINT AS o FROM line WHERE l_linestatus = 'F')) s
        ASOF LEFT JOIN function f ON s.image_id = f.image_id AND s.site >= f.address""",
    "literal": f"""SELECT *, CASE WHEN kind <> 'add' AND l_discount > 0.05 THEN l_extendedprice END AS value FROM (SELECT image_id, site, {DATA} + l_partkey * 8 AS target,
        (['add', 'ldr', 'ldur'])[l_linenumber % 3 + 1] AS kind, l_discount, l_extendedprice FROM line WHERE l_linestatus = 'O')""",
    "symbol": f"""SELECT (p_partkey * 7 % (SELECT n FROM n)) // {IMAGE} AS image_id, {BASE} + p_partkey * 7 % (SELECT n FROM n) * {STEP} AS address, p_name || '_' || p_partkey AS name,
        CASE WHEN p_size > 25 THEN p_type END AS demangled, p_size % 2 AS external FROM part""",
    "instr": f"""SELECT doc_id // {IMAGE} AS image_id, {BASE} + doc_id * {CODE} + 4 * k AS va,
        CASE k WHEN 0 THEN 'adrp' WHEN 1 THEN CASE WHEN doc_id % 4 = 0 THEN 'bl' ELSE 'add' END WHEN 2 THEN CASE WHEN doc_id % 6 = 0 THEN 'str' ELSE 'ldr' END WHEN 3 THEN 'ldr' WHEN 4 THEN CASE WHEN doc_id % 5 = 0 THEN 'mov' ELSE 'movk' END
            ELSE CASE WHEN doc_id % 7 = 0 THEN 'ret' WHEN doc_id % 7 < 4 THEN 'blraa' ELSE 'cmp' END END AS mnemonic,
        CASE k WHEN 0 THEN reg || ', #0x' || printf('%x', {DATA} + doc_id % 50 * 4096) WHEN 1 THEN CASE WHEN doc_id % 4 = 0 THEN '#0x' || printf('%x', {BASE} + doc_id * 53 % 4000 * {CODE}) ELSE 'x11, ' || reg || ', #0x' || printf('%x', doc_id % 64 * 8) END
            WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'd0' ELSE reg END || ', [' || reg || ', #0x' || printf('%x', doc_id % 9 * 8) || ']' WHEN 3 THEN 'x12, [x16, #0x' || printf('%x', doc_id % 16 * 8) || ']'
            WHEN 4 THEN CASE WHEN doc_id % 5 = 0 THEN 'x12, x19' ELSE 'x17, #0x' || printf('%x', 1 + doc_id % 999) || ', lsl #48' END ELSE CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 < 4 THEN 'x12, x17' ELSE 'x12, x13' END END AS operands, doc_id, k
        FROM (SELECT doc_id, 'x' || (8 + doc_id % 3) AS reg, unnest(range(6)) AS k FROM documents)""",
    "code_function": f"SELECT doc_id // {IMAGE} AS image_id, {BASE} + doc_id * {CODE} AS address FROM documents WHERE doc_id % 3 = 0",
    "virtual_call": f"""SELECT {BASE} + a.p_partkey * 7 % (SELECT n FROM n) * {STEP} + 4 AS site, (8 * (a.p_size % 16))::BIGINT AS slot_offset, 1 + a.p_partkey % 65535 AS discriminator,
        {BASE} + b.p_partkey * 7 % (SELECT n FROM n) * {STEP} AS candidate, b.p_name || '_' || b.p_partkey AS candidate_symbol, 'vcall-pac-v1' AS resolver FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey % 50 = 0""",
    "decompilation": f"""SELECT doc_id // {IMAGE} AS image_id, {BASE} + doc_id * {STEP} AS function, CASE WHEN n_chars >= 50 THEN text || chr(10) || 'return MEMORY[0x' || printf('%X', {ISLANDS} + doc_id * 16) || ']' END AS pseudocode,
        CASE WHEN n_chars < 50 THEN 0 ELSE n_chars END AS plain, CASE WHEN n_chars < 50 THEN 'Failed' ELSE 'Ok' END AS status, CASE WHEN n_chars < 50 THEN CASE WHEN doc_id % 2 = 0 THEN 'Function too big (2 MB)' ELSE 'no reason' END END AS reason FROM documents""",
    "partial": "SELECT image_id FROM image WHERE image_id % 4 = 0",
    "document_coverage": "SELECT source AS root, count(l.doc_id) AS read, count(*) AS total FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source",
    "section": "SELECT conv_id * 1000 + turn AS id, 'docs/re/conv-' || conv_id || '.md' AS file, turn::VARCHAR AS number, role AS title, turn * 10 + 1 AS first_line, turn * 10 + 10 AS last_line, text FROM conversations",
    "cited_text": f"""SELECT doc_id AS section, 'see 0x' || printf('%x', {BASE} + doc_id * 37 % (SELECT n FROM n) * {STEP}) || ' and `_$sFoo' || (doc_id % 97) || '` or `A.b' || (doc_id % 13) || '` in `main.cpp` at 0x12, again 0x' || printf('%x', {BASE} + doc_id * 37 % (SELECT n FROM n) * {STEP}) AS text FROM documents""",
    "seal_text": f"""SELECT 'src/' || source || '.h' AS file, doc_id + 1 AS line, '// [BIN Kit' || (doc_id % 7) || '] ' || CASE WHEN doc_id % 3 = 0 THEN 'no place' ELSE 'at 0x' || printf('%x', {BASE} + doc_id * 37 % (SELECT n FROM n) * {STEP}) END || ' [KIT] seen' AS text FROM documents""",
}
USES = {
    "image": ["n"], "coverage": ["image"], "partial": ["image"], "segment": ["image"], "call": ["n", "line", "function"], "literal": ["line"], "symbol": ["n"], "virtual_call": ["n"],
    "cited_text": ["n"], "seal_text": ["n"],
}


def with_tables(*names: str, more: str = "") -> str:
    """WITH clause that defines the named tables and what they use; more: further definitions."""
    need: set[str] = set()
    todo = list(names)
    while todo:
        if (x := todo.pop()) not in need:
            need.add(x)
            todo += USES.get(x, [])
    return "WITH " + ", ".join([f"{k} AS ({v})" for k, v in TABLES.items() if k in need] + ([more] if more else [])) + " "
