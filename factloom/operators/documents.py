"""Sections, citations and seals of documents kept as Latin-1 text (one character per byte)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import ascii_lower

#: Shape of a cache address, and of symbols (fixed patterns).
ADDRESS = r"0x(1[89a-f][0-9a-f]{7}|2[0-9a-f]{8})\b"
SYMBOL = r"^(_\$s[A-Za-z0-9_]+|_?\$?[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z][A-Za-z0-9_]*)+)$"
#: Endings of file names, which are no symbols (fixed values).
ENDINGS = (".h", ".hpp", ".cpp", ".md", ".py", ".json", ".cmake", ".ps1", ".txt", ".framework", ".dylib", ".frag", ".app", ".plist", ".ttf", ".ttc", ".car", ".bundle", ".metallib")
FILE_NAME = r".(" + "|".join(re.escape(e) for e in ENDINGS) + r")$"
GENERATED = "<!-- generated"

HEADING = re.compile(r"(#{1,6}) (.*)", re.DOTALL)
NUMBERED = re.compile(r"(?:Â§|§)?(\d+(?:\.\d+)*)\.?[ \t]+(.*)", re.DOTALL)
FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})(.*)", re.DOTALL)


def indent(line: str) -> int:
    """Columns before the first other character; a tab goes to the next multiple of four."""
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def parse_headings(text: str) -> list[tuple[int, int, str | None, str]]:
    """(line from 1, level, number, title) of each heading outside fences and indented code."""
    out, fence = [], ""
    for at, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r")
        mark = FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not mark[2].strip(" \t"):
                fence = ""
            continue
        if mark:
            fence = mark[1]
            continue
        if indent(line) >= 4 or not (h := HEADING.match(line.lstrip(" "))):
            continue
        title = h[2].strip(" \t")
        number = NUMBERED.fullmatch(title)
        out.append((at, len(h[1]), number[1] if number else None, number[2] if number else title))
    return out


HEADINGS = "array<struct<line:int,level:int,number:string,title:string>>"


def headings(files: DataFrame) -> DataFrame:
    """(file, line, level, number, title) of each heading of files (file, text), n_lines of the file beside it. A null text has none."""

    @F.arrow_udf(HEADINGS)
    def parse(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("line", pa.int32()), ("level", pa.int32()), ("number", pa.string()), ("title", pa.string())]))
        return pa.array([[dict(zip(("line", "level", "number", "title"), h, strict=True)) for h in parse_headings(t or "")] for t in texts.to_pylist()], kind)

    n_lines = F.size(F.split("text", "\n", -1)) - F.when(F.col("text").endswith("\n"), 1).otherwise(0)
    return files.select("file", n_lines.alias("n_lines"), F.explode(parse("text")).alias("h")).select("file", "n_lines", "h.*")


def section_spans(found: DataFrame) -> DataFrame:
    """Headings with last_line: before the next heading of the file whose level is not deeper, else the file's end. Nested sections stay inside their parents."""
    after = W.partitionBy("file").orderBy("line").rowsBetween(1, W.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= k, F.col("line") - 1)).over(after) for k in range(1, 7)]
    own = F.element_at(F.array(*ends), F.col("level"))
    return found.select("file", "number", "title", "level", F.col("line").alias("first_line"), F.coalesce(own, F.col("n_lines")).cast("int").alias("last_line"))


def sections(files: DataFrame) -> DataFrame:
    """Sections with their exact text, carriage returns and all."""
    spans = section_spans(headings(files)).join(files, "file")
    cut = F.slice(F.split("text", "\n", -1), F.col("first_line"), F.col("last_line") - F.col("first_line") + 1)
    body = F.array_join(cut, "\n")
    more = F.col("last_line") < F.size(F.split("text", "\n", -1))
    return spans.select("file", "number", "title", "level", "first_line", "last_line", F.concat(body, F.when(more, "\n").otherwise("")).alias("text"))


def citations(texts: DataFrame, key: str = "section") -> DataFrame:
    """(section, address, symbol) of each text: distinct addresses, and distinct symbols between backticks that are no paths or file names."""
    address = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(ADDRESS), F.lit(1))), lambda h: F.struct(F.conv(h, 16, 10).cast("long").alias("address"), F.lit(None).cast("string").alias("symbol")))
    tokens = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit("`([^`]+)`"), F.lit(1))), is_symbol)
    symbol = F.transform(tokens, lambda s: F.struct(F.lit(None).cast("long").alias("address"), s.alias("symbol")))
    return texts.select(key, F.explode(F.concat(address, symbol)).alias("c")).select(key, "c.*")


def is_symbol(token: Column) -> Column:
    return token.rlike(SYMBOL) & ~ascii_lower(token).rlike(FILE_NAME) & ~token.contains("/") & ~token.contains("\\")


def front_matter(texts: DataFrame) -> DataFrame:
    """(file, type, title, aliases, closed): keys between leading --- lines; the last of equal keys counts; aliases only inline. Without a leading --- line all are empty; closed is false if the second --- is missing."""
    block = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)(?:^|\n)---\r?(?:\n|\z)", 1)
    opens = F.col("text").rlike(r"\A---\r?(\n|\z)")
    closed = ~opens | F.col("text").rlike(r"(?s)\A---\r?\n(.*?\n)?---\r?(\n|\z)")

    def last(name: str) -> Column:
        every = F.regexp_extract_all(block, F.lit(rf"(?m)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$"), F.lit(1))
        return F.when(F.size(every) > 0, F.element_at(every, -1))

    aliases = F.regexp_extract(F.coalesce(last("aliases"), F.lit("")), r"^\[(.*)\]$", 1)
    listed = F.filter(F.transform(F.split(aliases, ","), lambda a: F.trim(F.regexp_replace(a, "[\"']", ""))), lambda a: a != "")
    return texts.select("file", last("type").alias("type"), last("title").alias("title"), listed.alias("aliases"), closed.alias("closed"), "text")


def concept_citations(concepts: DataFrame) -> DataFrame:
    """Citations of concepts (section, aliases, text): aliases first (0x: an address if it is all hex, else dropped; others symbols as they are), then those of the prose between front matter and the generated block; the two lists may repeat each other."""
    hexed = F.col("alias").rlike("^0x[0-9a-fA-F]{1,15}$")
    alias = concepts.select("section", F.explode("aliases").alias("alias"))
    address = F.when(hexed, F.conv(F.substring(F.col("alias"), F.lit(3), F.length("alias")), 16, 10).cast("long"))
    own = alias.where(hexed | ~F.col("alias").startswith("0x")).select("section", address.alias("address"), F.when(~F.col("alias").startswith("0x"), F.col("alias")).alias("symbol"))
    prose = F.regexp_replace("text", r"(?s)\A---\r?\n.*?\n---\r?(\n|\z)", "")
    prose = F.substring_index(prose, GENERATED, 1)
    return own.unionByName(citations(concepts.select("section", prose.alias("text"))))


def comment_blocks(source: DataFrame) -> DataFrame:
    """(file, first_line, text) of comment blocks, from lines (file, line, text).

    A run of // lines is a block; a line of code whose trimmed text has // within its first 8 characters and does not begin with a brace goes on an open block; any other line with // is its own block, from the slashes on.
    """
    trimmed = F.regexp_replace("text", r"^[ \t]+|[ \t\r]+$", "")
    lines = source.withColumn("t", trimmed).withColumn("slashes", F.instr("t", "//"))
    comment = F.col("t").startswith("//")
    glued = ~comment & ~F.col("t").rlike(r"^[{}]") & F.col("slashes").between(2, 8)
    kinds = lines.withColumn("c", comment.cast("int")).withColumn("o", (~comment & ~glued).cast("int"))
    w = W.partitionBy("file").orderBy("line")
    runs = kinds.withColumn("run", F.sum("o").over(w.rowsBetween(W.unboundedPreceding, 0)))
    open_ = F.max(F.when(F.col("o") == 0, F.col("c")).otherwise(0)).over(W.partitionBy("file", "run").orderBy("line").rowsBetween(W.unboundedPreceding, 0)) == 1
    marked = runs.withColumn("inside", (F.col("o") == 0) & open_)
    block = marked.where("inside").groupBy("file", "run").agg(F.min("line").alias("first_line"), F.sort_array(F.collect_list(F.struct("line", "t"))).alias("rows"))
    joined = block.select("file", "first_line", F.array_join("rows.t", "\n").alias("text"))
    alone = marked.where(~F.col("inside") & (F.col("slashes") > 0) & ~quoted()).select("file", F.col("line").alias("first_line"), F.substring(F.col("t"), F.col("slashes"), F.length("t")).alias("text"))
    return joined.unionByName(alone)


def quoted() -> Column:
    """Are the first slashes of a line inside a string literal?"""
    before = F.substring(F.col("t"), F.lit(1), F.col("slashes") - 1)
    return F.length(F.regexp_replace(before, r'[^"]', "")) % 2 == 1


def parse_seals(text: str, first_line: int, tags: re.Pattern, image_tag: str) -> list[tuple[int, str, str | None, int | None]]:
    """(line, tag, image, address) rows of one block; a segment ends at the next tag of the same name."""
    found = list(tags.finditer(text))
    out = []
    for k, m in enumerate(found):
        begin, image = m.end(), None
        if m[1] == image_tag and (named := IMAGE.match(text, begin)):
            image, begin = named[1], named.end()
        end = next((x.start() for x in found[k + 1 :] if x[1] == m[1]), len(text))
        line = first_line + text.count("\n", 0, m.start())
        at = [int(a[1], 16) for a in re.finditer(ADDRESS, text[begin:end])] if begin < end else []
        out += [(line, m[1], image, a) for a in at or [None]]
    return out


IMAGE = re.compile(r"\s+([A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*)")


def seals(blocks: DataFrame, tags: list[str], image_tag: str = "") -> DataFrame:
    """(file, line, tag, image, address) rows of comment blocks (file, first_line, text); a segment without an address is one row with a null one."""
    pattern, kind = re.compile(r"\[(" + "|".join(tags) + r")\]"), pa.list_(pa.struct([("line", pa.int64()), ("tag", pa.string()), ("image", pa.string()), ("address", pa.int64())]))

    @F.arrow_udf("array<struct<line:long,tag:string,image:string,address:long>>")
    def parse(texts: pa.Array, first: pa.Array) -> pa.Array:
        rows = [parse_seals(t or "", n, pattern, image_tag) for t, n in zip(texts.to_pylist(), first.to_pylist(), strict=True)]
        return pa.array([[dict(zip(("line", "tag", "image", "address"), r, strict=True)) for r in own] for own in rows], kind)

    # Blocks without any tag never reach Python.
    return blocks.where(F.col("text").contains("[")).select("file", F.explode(parse("text", "first_line")).alias("s")).select("file", "s.*")


def coverage(roots: DataFrame) -> DataFrame:
    """One row: files read and files there, of all collections."""
    zero = F.lit(0).cast("long")
    return roots.agg(F.coalesce(F.sum("read"), zero).alias("read"), F.coalesce(F.sum("total"), zero).alias("total"))


def cited_by(citation: DataFrame, section: DataFrame, address: int) -> DataFrame:
    return citation.where(F.col("address") == address).join(section, citation["section"] == section["id"]).select("file", "number", "title", "first_line", "last_line")


def blind_spot(rows: DataFrame, address: int) -> DataFrame:
    """(hits, blind): rows at an address, and those without one, counted only where there is no hit."""
    both = rows.agg(F.count_if(F.col("address") == address).alias("hits"), F.count_if(F.col("address").isNull()).alias("nulls"))
    return both.select("hits", F.when(F.col("hits") == 0, F.col("nulls")).alias("blind"))


def outline(section: DataFrame, slug: str) -> DataFrame:
    """Sections of the file /slug.md by place, with their line counts."""
    return section.where(F.col("file").endswith(f"/{slug}.md")).select("file", "number", "title", "first_line", (F.col("last_line") - F.col("first_line") + 1).alias("n_lines"))


def files_of_slug(section: DataFrame, slug: str) -> DataFrame:
    """Up to two files ending in /slug.md: two mean that the slug is ambiguous."""
    return section.where(F.col("file").endswith(f"/{slug}.md")).select("file").distinct().orderBy("file").limit(2)


def section_by_number(section: DataFrame, file: str, number: str) -> DataFrame:
    return section.where((F.col("file") == file) & (F.col("number") == number)).orderBy("id").limit(1)


def section_by_title(section: DataFrame, file: str, part: str) -> DataFrame:
    """The first section whose title contains part; if none does, the first that does without regard to ASCII case."""
    own = section.where(F.col("file") == file)
    low = part.translate({c: c + 32 for c in range(65, 91)})
    ranked = own.select("*", F.when(F.col("title").contains(part), 0).when(ascii_lower("title").contains(low), 1).alias("rank")).where("rank IS NOT NULL")
    return ranked.orderBy("rank", "id").limit(1).drop("rank")
