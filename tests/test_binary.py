import random
import struct

from factloom.functions.binary import as_double, discriminator, discriminator_of, pointer_target, siphash, suffix_of
from factloom.operators import binary


def test_discriminators(spark):
    assert siphash(bytes(range(15)), bytes(range(16))) == 0xA129CA6149BE45E5  # the published test vector
    name = "_ZN2CA3OGL11ImagingNode5applyEfPPNS0_7SurfaceEPf"
    assert discriminator_of(name) == 0x6779
    df = spark.createDataFrame([(name, 0), (None, 1)], "n string, k int")
    assert [r[0] for r in df.orderBy("k").select(discriminator("n")).collect()] == [0x6779, None]


def test_suffixes():
    assert suffix_of("_ZN2CA3OGL11ImagingNode5applyEfPf") == "5applyEfPf"
    assert suffix_of("_ZNK3Foo3barEv") == "3barEv" and suffix_of("_ZN3FooD1Ev") == "D1Ev"
    assert [suffix_of(n) for n in ("_Z3foov", "_ZN3FooIiE3barEv", "_ZN9Foo", "_ZN3Foo3bar")] == [None] * 4


def test_values(spark):
    bits = struct.unpack("<q", struct.pack("<d", 2.5))[0]
    r = spark.createDataFrame([(bits, (7 << 40) | 0x1234)], "b long, p long").select(as_double("b").alias("d"), pointer_target_column()).first()
    assert r["d"] == 2.5 and r["t"] == 0x180001234


def pointer_target_column():
    from pyspark.sql import functions as F

    return pointer_target(F.col("p"), 0x180000000).alias("t")


def test_decoding(spark):
    words = [0xF2E24690, 0xD73F0910, 0xF8696A08, 0x90000008, 0xFD400D00, 0xFC5F8100, 0x94000002, 0xD65F03C0, 0x91004108, 0x00000000]
    got = [(r["mnemonic"], r["operands"]) for r in binary.disassemble(spark.createDataFrame([(0, 0x1000 + 4 * k, w) for k, w in enumerate(words)], "image_id long, va long, word long")).orderBy("va").collect()]
    assert got == [("movk", "x16, #0x1234, lsl #48"), ("blraa", "x8, x16"), ("ldr", "x8, [x16, x9]"), ("adrp", "x8, #0x1000"), ("ldr", "d0, [x8, #0x18]"), ("ldur", "d0, [x8, #-0x8]"), ("bl", "#0x1020"), ("ret", ""), ("add", "x8, x8, #0x10")]


def instr(spark, rows):
    return spark.createDataFrame([(0, 0x1000 + 4 * k, m, o) for k, (m, o) in enumerate(rows)], "image_id long, va long, mnemonic string, operands string")


def test_literals(spark):
    code = [("adrp", "x8, #0x1000"), ("ldur", "d0, [x8, #-8]"), ("ldur", "d0, [x8, #-0x10]"), ("str", "x8, [x9]"), ("ldr", "d1, [x8]"), ("adrp", "x8, #0x2000"), ("bl", "#0x10"), ("ldr", "d1, [x8]")]
    assert [r["target"] for r in binary.literal_reads(instr(spark, code)).orderBy("site").collect()] == [0xFF8, 0xFF0]


def test_literals_against_a_walk(spark):
    rng = random.Random(3)
    regs = ["x1", "x2", "x3"]
    code = [rng.choice([("adrp", f"{rng.choice(regs)}, #0x{rng.randint(1, 9)}000"), ("ldr", f"{rng.choice(regs)}, [{rng.choice(regs)}, #0x{rng.randint(0, 255):x}]"), ("add", f"{rng.choice(regs)}, {rng.choice(regs)}, #0x10"), ("mov", f"{rng.choice(regs)}, x9"), ("ret", "")]) for _ in range(600)]
    page, want = {}, []
    for k, (m, o) in enumerate(code):
        p = o.split(", ")
        if m in binary.BARRIERS:
            page = {}
            continue
        if m == "add" and p[1] in page:
            want.append((0x1000 + 4 * k, page[p[1]] + int(p[2][1:], 16), m))
        if m == "ldr" and (base := p[1].strip("[")) in page:
            want.append((0x1000 + 4 * k, page[base] + int(p[2][1:-1], 16), m))
        page.pop(p[0], None)
        if m == "adrp":
            page[p[0]] = int(p[1][1:], 16)
    got = [(r["site"], r["target"], r["kind"]) for r in binary.literal_reads(instr(spark, code)).orderBy("site").collect()]
    assert got == want and len(got) > 20


def test_starts_and_symbols(spark):
    df = spark.createDataFrame([(0, 0x1000, bytes([0x10, 0x80, 0x01, 0x00, 0x05]))], "image_id long, base long, bytes binary")
    assert [r["address"] for r in binary.function_starts(df).orderBy("address").collect()] == [0x1010, 0x1090]
    raw = spark.createDataFrame([(0, "a", 0x0F, 5), (0, "a", 0x0F, 5), (0, "b", 0x0E, 6), (0, "c", 0x2E, 7), (0, "d", 0x0E, 0), (0, "e", 0x01, 9)], "image_id long, name string, type int, value long")
    assert sorted((r["name"], r["external"]) for r in binary.filtered_symbols(raw).collect()) == [("a", 1), ("b", 0)]


def test_islands_and_calls(spark):
    hop = spark.createDataFrame([(1, 2), (2, 3), (3, 100), (10, 11), (11, 10), (20, 21)], "island long, next long")
    owned = spark.createDataFrame([(100, 50)], "address long, size long")
    got = {r["island"]: r["target"] for r in binary.resolve(spark.createDataFrame([(1,), (10,), (20,), (3,)], "island long"), hop, owned).collect()}
    assert got == {1: 100, 10: None, 20: None, 3: 100}
    hops = binary.hops(instr(spark, [("b", "#0x40"), ("adrp", "x16, #0x5000"), ("add", "x16, x16, #0x20"), ("ldr", "x16, [x16, #0x8]")])).orderBy("island").collect()
    assert [(r["next"], r["pointer"]) for r in hops] == [(0x40, None), (None, 0x5028)]
    code = instr(spark, [("bl", "#0x1008"), ("bl", "#0x9000"), ("bl", "#0x8000")])
    rows = binary.calls(code, spark.createDataFrame([(0, 0x1004)], "image_id long, address long"), spark.createDataFrame([(0, 0x1000, 0x100)], "image_id long, address long, size long"), spark.createDataFrame([(0x9000, 0x7000)], "island long, target long")).orderBy("site").collect()
    assert [(r["caller"], r["target"], r["island"], r["via"]) for r in rows] == [(0, 0x1008, None, "Direct"), (0x1004, 0x7000, 0x9000, "Island"), (0x1004, 0x8000, 0x8000, "Unresolved")]


def test_virtual_calls(spark):
    code = [("ldr", "x16, [x0]"), ("mov", "x17, x0"), ("ldr", "x8, [x16, #0x78]"), ("movk", "x17, #0x6779, lsl #48"), ("blraa", "x8, x17"), ("ldr", "x8, [x16, x9]"), ("blraa", "x8, x17")]
    sites = binary.virtual_sites(instr(spark, code), spark.createDataFrame([(0, 0x1000)], "image_id long, address long"))
    assert [(r["site"], r["slot_offset"], r["discriminator"]) for r in sites.collect()] == [(0x1010, 0x78, 0x6779)]
    name = "__ZN2CA3OGL11ImagingNode5applyEfPPNS0_7SurfaceEPf"
    other = "__ZN2CA3OGL9OtherNode5applyEfPPNS0_7SurfaceEPf"
    tables = spark.createDataFrame([("ztv1", 0x5000), ("ztv2", 0x6000)], "ztv string, address long")
    cells = spark.createDataFrame([(0x5000 + 16 + 0x78, 0x100), (0x6000 + 16 + 0x78, 0x200)], "at long, target long")
    found = binary.families(sites, tables, cells, spark.createDataFrame([(0x100, name), (0x200, other)], "target long, name string")).collect()
    assert {(r["candidate"], r["candidate_symbol"]) for r in found} == {(0x100, name), (0x200, other)} and {r["resolver"] for r in found} == {"vcall-pac-v1"}


def test_instructions_without_a_destination(spark):
    """None of them clears its first register; anything else that writes does."""
    code = lambda m, o: [("ldr", "x8, [x16, #0x78]"), ("movk", "x17, #0x6779, lsl #48"), (m, o), ("blraa", "x8, x17")]
    start = spark.createDataFrame([(k, 0x1000) for k in range(60)], "image_id long, address long")
    kinds = [*((m, "x8, x9") for m in binary.NO_DESTINATION if not m.startswith(("bl", "br", "ret"))), ("b.eq", "#0x10"), ("mov", "x8, x9"), ("eor", "x8, x9, x10"), ("ldp", "x1, x8, [x2]")]
    rows = [(k, 0x1000 + 4 * n, *c) for k, (m, o) in enumerate(kinds) for n, c in enumerate(code(m, o))]
    got = {r["image_id"] for r in binary.virtual_sites(spark.createDataFrame(rows, "image_id long, va long, mnemonic string, operands string"), start).collect()}
    assert got == set(range(len(kinds) - 3))


def test_sites_look_back_a_window_at_most(spark):
    """Code more than 256 bytes before a site, or before its function, is not seen; across a bucket's border it is."""
    def site(start, gap):
        code = [("ldr", "x8, [x16, #0x10]"), ("movk", "x17, #0x5, lsl #48"), *[("nop", "")] * gap, ("blraa", "x8, x17")]
        return [(0x1F00 + start + 4 * k, m, o) for k, (m, o) in enumerate(code)]

    rows = [(k, *r) for k, (start, gap) in enumerate([(0, 62), (0, 63), (0xC0, 40), (0xF8, 1)]) for r in site(start, gap)]
    functions = spark.createDataFrame([(k, 0x1F00) for k in range(4)] + [(2, 0x1FC4)], "image_id long, address long")
    got = binary.virtual_sites(spark.createDataFrame(rows, "image_id long, va long, mnemonic string, operands string"), functions).collect()
    assert {r["image_id"] for r in got} == {0, 3}


def test_hops_across_buckets(spark):
    at = binary.BUCKET - 4
    code = [(0, at, "adrp", "x16, #0x5000"), (0, at + 4, "add", "x16, x16, #0x20"), (0, at + 8, "ldr", "x16, [x16, #0x8]"), (0, at + 12, "b", "#0x40")]
    rows = binary.hops(spark.createDataFrame(code, "image_id long, va long, mnemonic string, operands string")).orderBy("island").collect()
    assert [(r["island"], r["next"], r["pointer"]) for r in rows] == [(at, None, 0x5028), (at + 12, 0x40, None)]


def test_tables_end_at_the_next(spark):
    """A slot past a table's end or its cap is no member, whichever bucket the next table begins in."""
    name, d = "__ZN1A1fEv", discriminator_of("_ZN1A1fEv")
    tables = [("a", 0x1FE0), ("b", 0x2010), ("c", 0x5000)]
    sites = spark.createDataFrame([(0, slot, slot, d) for slot in (0x10, 0x18, 0x20, 0xFE8, 0xFF0)], "image_id long, site long, slot_offset long, discriminator long")
    cells = spark.createDataFrame([(at + 16 + slot, k * 10000 + slot) for k, (_, at) in enumerate(tables) for slot in (0x10, 0x18, 0x20, 0xFE8, 0xFF0)], "at long, target long")
    names = cells.selectExpr("target", f"'{name}' AS name")
    got = {(r["slot_offset"], r["candidate"]) for r in binary.families(sites, spark.createDataFrame(tables, "ztv string, address long"), cells, names).collect()}
    assert got == {(slot, k * 10000 + slot) for k, end in enumerate((0x30, 0x1000, 0x1000)) for slot in (0x10, 0x18, 0x20, 0xFE8, 0xFF0) if 16 + slot < end}


def test_values_of_literals(spark):
    bits = struct.unpack("<q", struct.pack("<d", 2.5))[0]
    reads = spark.createDataFrame([(0, 1, 0x40, "ldr", "d0"), (0, 2, 0x40, "ldr", "x0"), (0, 3, 0x44, "ldur", "d1"), (0, 4, 0x99, "ldr", "d1"), (0, 5, 0x40, "add", "d0")], "image_id long, site long, target long, kind string, dest string")
    got = binary.literal_values(reads, spark.createDataFrame([(0x40, bits), (0x44, 0)], "at long, raw long")).orderBy("site").collect()
    assert [r["value"] for r in got] == [2.5, None, 0.0, None, None]
