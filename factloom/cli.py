"""Command line: python -m factloom.cli VERB ... over stores that builds made (--store) or a model projected from tables (--tables), and python -m factloom.cli build facts|docs|pseudocode."""

from __future__ import annotations

import argparse
import importlib
import json
import resource
import sys
import time

from factloom.plans import answers, builds
from factloom.plans.verdict import FOUND, NOT_VERIFIED, Answer, Refusal, Verdict

VERSION = "0.2.0"
VERBS = {"q": ["what"], "callers": ["address"], "calls": ["address"], "refs": ["address"], "vcall": ["address"], "fn": ["address"], "grep": ["pattern"], "find": ["text"], "laudo": ["slug"], "status": []}
#: Verbs that say first which images they answer from.
HEADED = ("callers", "calls", "refs", "vcall", "fn", "grep", "status")


def number(text: str) -> int:
    return int(text, 16)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom")
    p.add_argument("--version", action="version", version=VERSION)
    verbs = p.add_subparsers(dest="verb", required=True)
    for name, args in VERBS.items():
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a, type=number if a == "address" else str)
        source = v.add_mutually_exclusive_group(required=True)
        source.add_argument("--tables", help="folder with the tables that a model is projected from")
        source.add_argument("--store", help="store of facts")
        v.add_argument("--documents", help="store of documents")
        v.add_argument("--code", help="store of pseudocode")
        v.add_argument("--config", help="configuration of the documents")
        v.add_argument("--root", help="root of the documents, to tell changed files")
        v.add_argument("--full", action="store_true")
        v.add_argument("--json", action="store_true")
        if name == "refs":
            v.add_argument("--to", type=number)
        if name == "fn":
            v.add_argument("--asm", action="store_true")
        if name == "grep":
            v.add_argument("--images", nargs="*")
            v.add_argument("--ignore-case", action="store_true")
            v.add_argument("--limit", type=int, default=200)
        if name == "laudo":
            v.add_argument("section", nargs="?")
    build = verbs.add_parser("build").add_subparsers(dest="what", required=True)
    facts, docs, code = (build.add_parser(n) for n in ("facts", "docs", "pseudocode"))
    facts.add_argument("--images-dir", required=True, help="folder of image files")
    chosen = facts.add_mutually_exclusive_group()
    chosen.add_argument("--images", nargs="*", help="basenames of the images to build, by spaces or commas")
    chosen.add_argument("--towers", help="tower map: its images are built")
    facts.add_argument("--store", required=True)
    facts.add_argument("--resume", action="store_true")
    facts.add_argument("--cache", help="main file of the split cache whose pointers the images load")
    facts.add_argument("--demangle", help="hook module:function, from a name to its plain form or None")
    docs.add_argument("--root", required=True)
    docs.add_argument("--config", help="configuration; else the nearest one from the root upwards")
    docs.add_argument("--documents", required=True)
    code.add_argument("--work", required=True, help="Parquet table of functions: image_id, function, bytes, tower, name")
    code.add_argument("--code", required=True)
    code.add_argument("--hook", required=True, help="module:function, from a row to (text, status, reason, seconds)")
    code.add_argument("--batch", type=int, default=1000)
    for b in (facts, docs, code):
        b.add_argument("--json", action="store_true")
    return p


def hook(name: str):
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError) as e:
        raise Refusal("Usage", "load hook", name, str(e), "name it as module:function") from None


def configuration(path: str | None, root: str | None):
    from factloom.sources import config

    found = path or (str(config.discover(root)) if root else None)
    if found is None:
        return None
    try:
        with open(found, "rb") as f:
            return config.parse(f.read())
    except OSError as e:
        raise Refusal("Io", "load configuration", found, str(e)) from None


def opened(spark, a: argparse.Namespace) -> answers.Facts:
    if a.tables:
        from factloom.sources.projection import Projection

        return answers.Facts.projected(Projection(spark, a.tables))
    own = configuration(a.config, None)
    disk = None
    if a.root and own:
        from pyspark.sql import functions as F

        from factloom.sources import corpus

        for c in own.collections:
            part = corpus.walk(spark, a.root, c).select(F.col("file").alias("path"), "size", "mtime")
            disk = part if disk is None else disk.unionByName(part)
    return answers.Facts.stored(spark, a.store, a.documents, a.code, own.sha256 if own else None, disk)


def answer(f: answers.Facts, a: argparse.Namespace) -> Answer:
    if a.verb in ("callers", "calls", "vcall"):
        return getattr(answers, a.verb)(f, a.address, a.full)
    if a.verb == "refs":
        return answers.refs(f, a.address, a.to, a.full)
    if a.verb == "fn":
        return answers.fn(f, a.address, a.asm, a.full)
    if a.verb == "grep":
        return answers.search(f, a.pattern, a.images, a.ignore_case, a.limit)
    return {"q": lambda: answers.question(f, a.what, a.full), "find": lambda: answers.find(f, a.text), "laudo": lambda: answers.laudo(f, a.slug, a.section), "status": lambda: answers.status(f)}[a.verb]()


def build(spark, a: argparse.Namespace) -> int:
    """A build; it exits with 1 if it looked and something failed, with 2 if it could not look."""
    began = time.perf_counter()
    if a.what == "facts":
        from factloom.sources import cache
        from factloom.sources.stores import Store

        cells = cache.cells(spark, cache.Cache(a.cache)) if a.cache else None
        names = [n for group in a.images or () for n in group.split(",") if n]
        wanted = builds.tower_map(spark, a.towers) if a.towers else spark.createDataFrame([(n, None) for n in names], "base string, tower string") if names else None
        verdict = builds.build_facts(spark, a.images_dir, a.store, a.resume, cells, hook(a.demangle) if a.demangle else None, wanted)
        image = Store(spark, a.store, "Catalog").table("image")
        rows = image.select("path", "facts_state", "reason").orderBy("path").collect()  # a row for each image
        failed = [{"image": r["path"], "reason": r["reason"]} for r in rows if r["facts_state"] != "FactsDone"]
        if a.json:
            peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
            print(json.dumps({"built": verdict.count, "failed": len(failed), "elapsed_seconds": round(time.perf_counter() - began, 1), "peak_mib": round(peak, 1), "not_verified": 0, "images": [r["path"] for r in rows if r["facts_state"] == "FactsDone"], "failures": failed}))
        else:
            print(*(f"  failed: {x['image']}  {x['reason']}" for x in failed), verdict.line(), sep="\n")
        return 1 if failed else verdict.exit_code
    if a.what == "docs":
        verdict = builds.build_documents(spark, a.root, configuration(a.config, a.root), a.documents)
    else:
        verdict = builds.build_pseudocode(spark, spark.read.parquet(a.work), hook(a.hook), a.code, a.batch)
    print(Answer(verdict).to_json() if a.json else verdict.line())
    return verdict.exit_code


def refused(e: Refusal, as_json: bool) -> int:
    out = Answer(Verdict(NOT_VERIFIED, why=str(e)))
    print(out.to_json() if as_json else out.verdict.line())
    return 1 if e.verified else 2


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        if e.code:
            print(Verdict(NOT_VERIFIED, why="usage").line())
        return 2 if e.code else 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("factloom").getOrCreate()
    from factloom.session import importable

    importable(spark)
    try:
        if a.verb == "build":
            return build(spark, a)
        f = opened(spark, a)
        out = answer(f, a)
        if a.verb in HEADED:
            out.output.insert(0, answers.header(f))
    except Refusal as e:
        return refused(e, a.json)
    if a.json:
        out.output += list(out.stream or ())
        print(out.to_json())
    else:
        for line in out.stream or ():
            print(line)
        print(*out.output, sep="\n")
        if not (a.verb == "laudo" and a.section and out.verdict.kind == FOUND):
            print(out.verdict.line())
    return out.verdict.exit_code


if __name__ == "__main__":
    sys.exit(main())
