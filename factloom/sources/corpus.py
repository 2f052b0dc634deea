"""Files of a documentation corpus, read through Spark's binaryFile source."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import bytes_as_text
from factloom.operators import documents
from factloom.plans.verdict import Refusal
from factloom.sources.config import Collection, Config

SKIPPED = r"/(build|lab|\.git)/"


def walk(spark: SparkSession, root: str, collection: Collection) -> DataFrame:
    """(file, size, mtime, text): markdown of the folder itself for evidence and concepts (but README.md and index.md), sources of all folders below for code."""
    base = f"{root.rstrip('/')}/{collection.path}"
    # A file that is listed but cannot be read is missing from the texts, and so from what was read.
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", collection.kind == "code").option("ignoreMissingFiles", True)
    if collection.kind == "code":
        rows = reader.load(base)
        keep = F.lit(False)
        for ending in collection.extensions:
            keep |= F.col("path").endswith(ending)
        rows = rows.where(keep & ~F.col("path").rlike(SKIPPED))
    else:
        rows = reader.option("pathGlobFilter", "*.md").load(base).where(~F.substring_index("path", "/", -1).isin("README.md", "index.md"))
    # The part after the root; the scheme before it depends on the file system.
    file = F.concat(F.lit(collection.path + "/"), F.substring_index("path", f"/{collection.path}/", -1))
    return rows.select(file.alias("file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), bytes_as_text("content").alias("text"))


def build(spark: SparkSession, root: str, config: Config) -> dict[str, DataFrame]:
    """Tables of a documents store: file, section, citation, seal, coverage, meta."""
    parts: dict[str, list[DataFrame]] = {k: [] for k in ("file", "section", "citation", "seal", "coverage")}
    for c in config.collections:
        files = walk(spark, root, c)
        parts["file"].append(files.select(F.col("file").alias("path"), "size", "mtime"))
        # Total: files that the folder lists; read: those whose content came.
        listed = files.agg(F.count("file").alias("total"))
        read = files.where(F.length("text") >= 0).agg(F.count("text").alias("read"))
        parts["coverage"].append(listed.join(read, F.lit(True)).select(F.lit(c.path).alias("root"), "read", "total"))
        if c.kind == "code":
            lines = files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).select("file", (F.col("line") + 1).cast("long").alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))
            if config.tags:
                parts["seal"].append(documents.seals(documents.comment_blocks(lines), list(config.tags), config.image_tag))
            continue
        if c.kind == "evidence":
            own = documents.sections(files.select("file", "text")).select("file", "number", "title", "first_line", "last_line", "text", F.lit(None).cast("array<string>").alias("aliases"))
        else:
            matter = documents.front_matter(files.select("file", "text"))
            n = F.size(F.split("text", "\n", -1)) - F.when(F.col("text").endswith("\n"), 1).otherwise(0)
            broken = F.raise_error(F.concat(F.lit("front matter does not end: "), F.col("file")))
            title = F.when(F.col("closed"), F.coalesce("title", "file")).otherwise(broken.cast("string"))
            own = matter.select("file", F.lit(None).cast("string").alias("number"), title.alias("title"), F.lit(1).alias("first_line"), n.alias("last_line"), "text", "aliases")
        own = own.withColumn("id", F.xxhash64("file", "first_line"))
        parts["section"].append(own.drop("aliases"))
        texts = own.select(F.col("id").alias("section"), "text", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
        parts["citation"].append(documents.concept_citations(texts) if c.kind == "concept" else documents.citations(texts))
    out = {}
    for name, frames in parts.items():
        for f in frames:
            out[name] = out[name].unionByName(f) if name in out else f
    meta = [("Kind", "Documents"), ("SchemaVersion", "1"), ("ConfigSha256", config.sha256)]
    return out | {"meta": spark.createDataFrame(meta, "key string, value string")}


def head(repository: str) -> str:
    """The commit that HEAD of a git repository names: detached, loose, packed, in a linked worktree."""
    git = Path(repository) / ".git"
    if git.is_file():
        git = (git.parent / git.read_text().removeprefix("gitdir:").strip()).resolve()
    common = git
    if (git / "commondir").is_file():
        common = (git / (git / "commondir").read_text().strip()).resolve()
    try:
        text = (git / "HEAD").read_text().strip()
        if not text.startswith("ref: "):
            return text
        ref = text.removeprefix("ref: ")
        for folder in (git, common):
            if (folder / ref).is_file():
                return (folder / ref).read_text().strip()
        for line in (common / "packed-refs").read_text().splitlines():
            if line.endswith(f" {ref}"):
                return line.split()[0]
    except OSError as e:
        raise Refusal("Io", "resolve HEAD", repository, str(e)) from None
    raise Refusal("NotFound", "resolve HEAD", repository, f"{ref} is in no store")
