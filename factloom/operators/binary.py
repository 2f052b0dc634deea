"""Facts from instruction tables: instr(image_id, va, mnemonic, operands)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.binary import as_double, discriminator, mnemonic, operands, signature_suffix
from factloom.operators.asof import asof_floor, range_join
from factloom.session import saved

#: Instructions after which no register is known (fixed values).
BARRIERS = ("bl", "blr", "ret", "retaa", "retab", "br", "braa", "brab", "braaz", "brabz", "blraa", "blrab", "blraaz", "blrabz", "brk")
MOST_HOPS, HOP_BYTES, WINDOW, VTABLE = 8, 32, 0x100, 0x1000
#: Bytes of code that one task's window holds.
BUCKET = 1 << 18
RESOLVER = "vcall-pac-v1"


def disassemble(words: DataFrame) -> DataFrame:
    """Instructions of words (image_id, va, word); words without a known pattern are skipped."""
    return words.select("image_id", "va", mnemonic(F.col("word")).alias("mnemonic"), operands(F.col("word"), F.col("va")).alias("operands")).where("mnemonic IS NOT NULL")


def decode_coverage(words: DataFrame) -> DataFrame:
    """Decoded and total words of each image, of our decoder."""
    return words.groupBy("image_id").agg(F.count(mnemonic(F.col("word"))).alias("read"), F.count("*").alias("total"))


def immediate(text: Column) -> Column:
    """The number of #0x..., #-0x... or #...; null for anything else."""
    digits = F.regexp_extract(text, r"^#-?(?:0x([0-9a-f]{1,15})|[0-9]{1,18})$", 1)
    plain = F.regexp_extract(text, r"^#-?([0-9]{1,18})$", 1)
    value = F.when(digits != "", F.conv(digits, 16, 10).cast("long")).when(plain != "", plain.try_cast("long"))
    return F.when(text.startswith("#-"), -value).otherwise(value)


def function_starts(encoded: DataFrame) -> DataFrame:
    """Addresses from ULEB128 deltas (image_id, base, bytes as binary): a delta of zero ends; a number that breaks off is refused."""

    def decode(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for image, base, data in zip(frame["image_id"], frame["base"], frame["bytes"], strict=True):
            at, value, shift = int(base), 0, 0
            for k, byte in enumerate(data):
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    if not value:
                        break
                    at += value
                    rows.append((image, at))
                    value = shift = 0
                elif shift >= 63 or k + 1 == len(data):
                    raise ValueError(f"image {image}: a delta overflows or breaks off")
        return pd.DataFrame(rows, columns=["image_id", "address"])

    return encoded.select("image_id", "base", "bytes").mapInPandas(lambda frames: map(decode, frames), "image_id long, address long")


def filtered_symbols(raw: DataFrame) -> DataFrame:
    """Symbols of raw entries (image_id, name, type, value): no debugging entry, defined in a section, not at zero; external by bit 0."""
    kind = F.col("type")
    keep = (kind.bitwiseAND(0xE0) == 0) & (kind.bitwiseAND(0x0E) == 0x0E) & (F.col("value") != 0) & F.col("name").isNotNull()
    return raw.where(keep).select("image_id", F.col("value").alias("address"), "name", kind.bitwiseAND(1).alias("external")).dropDuplicates(["image_id", "address", "name"])


def hops(instr: DataFrame) -> DataFrame:
    """(island, next, pointer): where the 32 bytes of code from an address jump on: an address loaded through adrp (+ add) and ldr, or a plain branch. `pointer` marks addresses still to be read.

    Code is dealt by address buckets; the first bytes of a bucket are seen from the one before, too.
    """
    bucket = F.floor(F.col("va") / BUCKET)
    dealt = instr.withColumn("at", F.explode(F.when(F.col("va") % BUCKET < HOP_BYTES, F.array(bucket, bucket - 1)).otherwise(F.array(bucket))))
    w = W.partitionBy("image_id", "at").orderBy("va").rangeBetween(0, HOP_BYTES - 4)
    ahead = dealt.withColumn("code", F.collect_list(F.struct("va", "mnemonic", "operands")).over(w)).where(F.col("at") == bucket)
    first, second, third = (F.try_element_at(F.sort_array("code"), F.lit(k)) for k in (1, 2, 3))
    page = immediate(F.substring_index(first["operands"], ", ", -1))
    added = F.when(second["mnemonic"] == "add", immediate(F.substring_index(second["operands"], ", ", -1))).otherwise(0)
    load = F.when(second["mnemonic"] == "add", third).otherwise(second)
    offset = F.coalesce(immediate(F.regexp_extract(load["operands"], r"\[[^,\]]+, (#[^\]]+)\]", 1)), F.lit(0))
    cell = F.when((first["mnemonic"] == "adrp") & (load["mnemonic"] == "ldr"), page + added + offset)
    plain = F.when(first["mnemonic"] == "b", immediate(first["operands"]))
    return ahead.select(F.col("va").alias("island"), plain.alias("next"), cell.alias("pointer")).where("next IS NOT NULL OR pointer IS NOT NULL")


def resolve(islands: DataFrame, hop: DataFrame, owned: DataFrame) -> DataFrame:
    """(island, target): each island followed for at most eight hops until an address in a segment of owned (address, size); cycles and dead ends resolve to null.

    One join per hop over those still under way, which are written down after each; addresses seen are kept in the row, so a cycle ends.
    """
    every = saved(islands.select("island").distinct(), "islands")
    at = every.select("island", F.col("island").alias("current"), F.array("island").alias("seen"))
    forward = hop.where("next IS NOT NULL").select(F.col("island").alias("current"), "next")
    settled = None
    for _ in range(MOST_HOPS):
        step = at.join(forward, "current").where("NOT array_contains(seen, next)").select("island", "next", F.concat("seen", F.array("next")).alias("seen"))
        held = range_join(step.select("next").distinct(), owned, "next", "address", "size", how="left_semi").withColumn("held", F.lit(True))
        step = saved(step.join(held, "next", "left"), "hops")
        here = step.where("held").select("island", F.col("next").alias("target"))
        settled = here if settled is None else settled.unionByName(here)
        at = step.where("held IS NULL").select("island", F.col("next").alias("current"), "seen")
        if at.isEmpty():
            break
    return every.join(settled, "island", "left")


def calls(instr: DataFrame, function: DataFrame, text: DataFrame, resolved: DataFrame) -> DataFrame:
    """Call rows of all bl: direct into the image's own text, through a resolved island, or unresolved with the raw target."""
    sites = instr.where("mnemonic = 'bl'").select("image_id", F.col("va").alias("site"), immediate(F.col("operands")).alias("raw"))
    within = sites.join(text.select("image_id", "address", "size"), "image_id").withColumn("direct", (F.col("raw") >= F.col("address")) & (F.col("raw") < F.col("address") + F.col("size")))
    named = within.join(resolved.select(F.col("island").alias("raw"), F.col("target").alias("far")), "raw", "left")
    via = F.when(F.col("direct"), "Direct").when(F.col("far").isNotNull(), "Island").otherwise("Unresolved")
    rows = named.select("image_id", "site", F.when(via == "Island", F.col("far")).otherwise(F.col("raw")).alias("target"), F.when(via != "Direct", F.col("raw")).alias("island"), via.alias("via"))
    found = asof_floor(rows, function.select("image_id", F.col("address").alias("start")), ["image_id"], "site", "start")
    return found.select("image_id", "site", F.coalesce("start", F.lit(0).cast("long")).alias("caller"), "target", "island", "via")


def literal_reads(instr: DataFrame) -> DataFrame:
    """(image_id, site, target, kind, dest): addresses read through adrp, add and ldr/ldur.

    Joins and windows instead of a walk: barriers part each image's code into segments, each named by its barrier (the last one at or before an instruction); in a segment every instruction writes an event for its first operand's register (a page, or nothing known), and a read takes the last event of its base register before it. No window spans an image. `dest` is the register that a read goes to.
    """
    parts = F.split("operands", ", ")
    barriers = instr.where(F.col("mnemonic").isin(*BARRIERS)).select("image_id", F.col("va").alias("segment"))
    code = asof_floor(instr.select("image_id", "va", "mnemonic", "operands"), barriers, ["image_id"], "va", "segment").withColumn("segment", F.coalesce("segment", F.lit(-1).cast("long"))).withColumn("p", parts)
    base = F.regexp_extract("operands", r"\[([a-z0-9]+)(?:, #[^\]]*)?\]", 1)
    offset = immediate(F.regexp_extract("operands", r"\[[a-z0-9]+, (#[^\]]+)\]", 1))
    add = (F.col("mnemonic") == "add") & (F.size("p") == 3) & F.element_at("p", 3).startswith("#")
    load = F.col("mnemonic").isin("ldr", "ldur") & (base != "")
    reads = code.where(add | load).select("image_id", "va", "segment", F.lit(0).alias("order"), F.when(add, F.element_at("p", 2)).otherwise(base).alias("reg"), F.lit(None).cast("struct<page:long>").alias("event"), F.col("mnemonic").alias("kind"), F.when(add, immediate(F.element_at("p", 3))).otherwise(F.coalesce(offset, F.lit(0))).alias("offset"), F.element_at("p", 1).alias("dest"))
    page = F.when(F.col("mnemonic") == "adrp", immediate(F.element_at("p", 2)))
    writes = code.where("operands <> ''").select("image_id", "va", "segment", F.lit(1).alias("order"), F.element_at("p", 1).alias("reg"), F.struct(page.alias("page")).alias("event"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("string").alias("dest"))
    before = W.partitionBy("image_id", "segment", "reg").orderBy("va", "order").rowsBetween(W.unboundedPreceding, -1)
    known = reads.unionByName(writes).withColumn("last", F.last("event", ignorenulls=True).over(before))
    return known.where("order = 0 AND last.page IS NOT NULL").select("image_id", F.col("va").alias("site"), F.try_add(F.col("last.page"), F.col("offset")).alias("target"), "kind", "dest").where("target >= 0")


def literal_values(reads: DataFrame, cell: DataFrame) -> DataFrame:
    """Literal reads with value: the 64-bit float that a load into a d register reads, from 8-byte cells (at, raw); null for others and where nothing is mapped."""
    loads = F.col("kind").isin("ldr", "ldur") & F.col("dest").startswith("d")
    keyed = reads.withColumn("at", F.when(loads, F.col("target")))
    return keyed.join(cell.select("at", "raw"), "at", "left").select("image_id", "site", "target", "kind", F.when(F.col("raw").isNotNull(), as_double("raw")).alias("value"))


#: Instructions that write no register (fixed values); conditional branches (b.) beside them.
NO_DESTINATION = (
    "str", "stur", "sturb", "sturh", "strb", "strh", "stp", "cmp", "cmn", "tst", "b", "bl", "blr", "br", "blraa", "blraaz", "braa", "braaz", "blrab", "blrabz", "brab", "brabz",
    "ret", "retaa", "retab", "cbz", "cbnz", "tbz", "tbnz", "nop", "prfm", "autda", "autdb", "autia", "autib", "xpacd", "xpaci", "brk", "fcmp",
)
REGISTER, MEMORY = re.compile(r"[xwd][0-9]+|sp|xzr"), re.compile(r"\[([a-z0-9]+)(?:, #(-?0x[0-9a-f]+|-?\d+))?\](!?)$")


class Registers:
    """What is known of registers in a window before a virtual call: slot offset, discriminator, address offset, constant."""

    def __init__(self):
        self.known: dict[str, dict[str, int]] = {}

    def get(self, reg: str, what: str) -> int | None:
        return self.known.get(reg, {}).get(what)

    def step(self, name: str, text: str) -> None:
        p = [x.strip() for x in text.split(",")]
        number = lambda x: int(x[1:], 0)
        known = self.known
        if name == "movk" and len(p) == 3 and p[2] == "lsl #48":
            known[p[0]] = {k: v for k, v in known.get(p[0], {}).items() if k != "slot"} | {"disc": number(p[1])}
        elif name == "ldr" and (m := MEMORY.search(text)):
            at = (self.get(m[1], "addr") or 0) + int(m[2] or "0", 0)
            known[p[0]] = {"slot": at}
            if m[3]:
                known.setdefault(m[1], {})["addr"] = at
        elif name == "add" and len(p) == 3 and (more := number(p[2]) if p[2].startswith("#") else self.get(p[2], "const")) is not None:
            kept = {k: v for k, v in known.get(p[0], {}).items() if k == "const"}
            known[p[0]] = kept | {"addr": (self.get(p[1], "addr") or 0) + more}
        elif name == "mov" and len(p) == 2 and p[1].startswith("#"):
            known[p[0]] = {"const": number(p[1])}
        elif name == "mov" and len(p) == 2 and REGISTER.fullmatch(p[1]):
            known[p[0]] = dict(known.get(p[1], {}))
        elif name not in NO_DESTINATION and not name.startswith("b.") and p and REGISTER.fullmatch(p[0]):
            known.pop(p[0], None)
            if name == "ldp" and len(p) > 1:
                known.pop(p[1], None)


def virtual_sites(instr: DataFrame, function: DataFrame) -> DataFrame:
    """(image_id, site, instruction, slot_offset, discriminator) of authenticated calls whose slot and discriminator are known from the 64 instructions before, within the function."""
    sites = instr.where("mnemonic IN ('blraa', 'braa')").select("image_id", F.col("va").alias("site"), F.col("mnemonic").alias("name"), F.col("operands").alias("text"))
    found = asof_floor(sites, function.select("image_id", F.col("address").alias("start")), ["image_id"], "site", "start")
    # Sites meet the code of their own 256 bytes and of the 256 before: an equi join, so only code near a site is gathered.
    near = found.withColumn("at", F.explode(F.array(F.floor(F.col("site") / WINDOW), F.floor(F.col("site") / WINDOW) - 1)))
    code = instr.select("image_id", F.floor(F.col("va") / WINDOW).alias("at"), "va", "mnemonic", "operands")
    ahead = near.join(code, ["image_id", "at"]).where((F.col("va") < F.col("site")) & (F.col("va") >= F.col("site") - WINDOW) & (F.col("va") >= F.coalesce("start", F.lit(0))))
    gathered = ahead.groupBy("image_id", "site", "name", "text").agg(F.sort_array(F.collect_list(F.struct("va", "mnemonic", "operands"))).alias("code"))

    def track(frames):
        for f in frames:
            rows = []
            for image, site, name, text, code in zip(f["image_id"], f["site"], f["name"], f["text"], f["code"], strict=True):
                state = Registers()
                for c in code:
                    state.step(c["mnemonic"], c["operands"])
                target, context = (x.strip() for x in text.split(","))
                slot, disc = state.get(target, "slot"), state.get(context, "disc")
                if slot is not None and disc is not None:
                    rows.append((image, site, f"{name} {text}", slot, disc))
            yield pd.DataFrame(rows, columns=["image_id", "site", "instruction", "slot_offset", "discriminator"])

    return gathered.mapInPandas(track, "image_id long, site long, instruction string, slot_offset long, discriminator long")


def families(sites: DataFrame, tables: DataFrame, cells: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates of virtual sites: members of all tables whose signature suffix is that of a member with the site's discriminator.

    tables: (ztv, address) of table symbols, each up to the next symbol and VTABLE bytes; cells: (at, target) decoded pointers; names: (target, name). A table has VTABLE / 8 slots at most, which are listed and joined by their offset; distinct (slot, discriminator) pairs are joined once, then spread to their sites.
    """
    # The next table counts only within VTABLE bytes: it is in the same bucket or first in the next one.
    bucket = F.floor(F.col("address") / VTABLE)
    after = F.lead("address").over(W.partitionBy("bucket").orderBy("address"))
    first = tables.groupBy((bucket - 1).alias("bucket")).agg(F.min("address").alias("following"))
    spans = tables.withColumn("bucket", bucket).withColumn("after", after).join(first, "bucket", "left")
    end = F.least(F.coalesce("after", "following", F.col("address") + VTABLE), F.col("address") + VTABLE)
    listed = spans.withColumn("slot_offset", F.explode(F.sequence(F.lit(0), F.greatest(end - F.col("address") - 24, F.lit(0)).cast("long"), F.lit(8)))).where(F.col("address") + 16 + F.col("slot_offset") < end)
    wanted = sites.select("slot_offset", F.col("discriminator").alias("d")).distinct()
    members = listed.join(wanted.select("slot_offset").distinct(), "slot_offset", "left_semi").select("ztv", "slot_offset", (F.col("address") + 16 + F.col("slot_offset")).alias("at"))
    named = members.join(cells, "at").join(names, "target").withColumn("plain", F.regexp_replace("name", "^_(?=_Z)", "")).withColumn("suffix", signature_suffix("plain")).withColumn("d", discriminator("plain"))
    anchors = named.join(wanted, ["slot_offset", "d"]).select("slot_offset", F.col("d").alias("discriminator"), "suffix").where("suffix IS NOT NULL").distinct()
    family = anchors.join(named.select("slot_offset", "suffix", "target", "name", "ztv"), ["slot_offset", "suffix"]).groupBy("slot_offset", "discriminator", F.col("target").alias("candidate")).agg(F.min_by("name", "ztv").alias("candidate_symbol"))
    return sites.join(family, ["slot_offset", "discriminator"]).withColumn("resolver", F.lit(RESOLVER))
