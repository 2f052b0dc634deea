import struct

import pytest

from factloom.plans.verdict import Refusal
from factloom.sources import cache

BASE, ADD = 0x180000000, 0x170000000


def part(uuid: bytes, mappings, body: bytes, subcaches=(), images=(), symbols=bytes(16)) -> bytes:
    """A cache file: (address, size, slide) mappings that follow one another in body, which begins at 0x2000."""
    head = bytearray(0x2000)
    head[:15] = b"dyld_v1  arm64e"
    plain, slid, at = 0x400, 0x600, 0x2000
    struct.pack_into("<2I", head, 0x10, plain, len(mappings))
    struct.pack_into("<2I", head, 0x138, slid, len(mappings))
    head[0x58:0x68], head[0x190:0x1A0] = uuid, symbols
    for k, (address, size, slide) in enumerate(mappings):
        info = 0
        if slide:
            info = 0xA00 + 0x100 * k
            version, page, starts = slide
            struct.pack_into("<4IQ", head, info, version, page, len(starts), 0, ADD)
            struct.pack_into(f"<{len(starts)}H", head, info + 24, *starts)
        struct.pack_into("<3Q2I", head, plain + 32 * k, address, size, at, 5, 5)
        struct.pack_into("<6Q2I", head, slid + 56 * k, address, size, at, info, 24 if slide else 0, 0, 5, 5)
        at += size
    for k, (own, suffix) in enumerate(subcaches):
        struct.pack_into("<16sQ32s", head, 0x1000 + 56 * k, own, 0, suffix.encode())
    struct.pack_into("<2I", head, 0x188, 0x1000, len(subcaches))
    for k, (path, address) in enumerate(images):
        struct.pack_into("<3Q2I", head, 0x1400 + 32 * k, address, 0, 0, 0x1800 + 64 * k, 0)
        head[0x1800 + 64 * k : 0x1800 + 64 * k + len(path)] = path.encode()
    struct.pack_into("<2I", head, 0x1C0, 0x1400, len(images))
    return bytes(head) + body


def pointer(target: int, delta: int = 0) -> int:
    return target - ADD | delta << 52


@pytest.fixture
def folder(tmp_path):
    text, data = bytes(range(64)), bytearray(0x300)
    for at, raw in ((0x10, pointer(BASE + 8, 2)), (0x20, pointer(BASE + 0x20, 3)), (0x38, pointer(0x190000010)), (0x200, pointer(BASE + 4, 1)), (0x208, 0), (0x210, pointer(0x1F0000000))):
        struct.pack_into("<Q", data, at, raw)
    sub = bytes([7] * 16)
    (tmp_path / "cache").write_bytes(part(bytes(range(16)), [(BASE, 64, None), (BASE + 0x1000, 0, None)], text, [(sub, ".01")], [("/usr/lib/a", BASE)]))
    (tmp_path / "cache.01").write_bytes(part(sub, [(0x190000000, 0x300, (5, 0x100, (0x10, 0xFFFF, 0x0)))], bytes(data)))
    return tmp_path


def test_addresses(folder):
    c = cache.Cache(str(folder / "cache"))
    assert c.uuid == bytes(range(16)).hex() and c.images == [("/usr/lib/a", BASE)] and [m.address for m in c.mappings] == [BASE, 0x190000000]
    assert c.read(BASE + 4, 4) == bytes([4, 5, 6, 7]) and c.mapped(BASE + 63) and not c.mapped(BASE + 64) and not c.mapped(BASE - 1)
    for va, size in ((BASE + 60, 8), (BASE + 64, 1), (0, 1)):
        with pytest.raises(Refusal, match="NotFound"):
            c.read(va, size)


def test_pointers(folder):
    c = cache.Cache(str(folder / "cache"))
    assert c.pointer(0x190000010) == BASE + 8 and c.pointer(0x190000038) == 0x190000010
    for slot, why in ((0x190000208, "zero"), (0x190000210, "not mapped"), (BASE, "no slide"), (0x1, "no mapping")):
        with pytest.raises(Refusal, match=why):
            c.pointer(slot)
    links = {0x10, 0x20, 0x38}
    assert {k for k in range(0, 0x100, 8) if c.rebased(0x190000000 + k)} == links and not c.rebased(0x190000110)


def test_cells_of_all_pages(spark, folder):
    got = {(r["at"], r["target"]) for r in cache.cells(spark, cache.Cache(str(folder / "cache"))).collect()}
    assert got == {(0x190000010, BASE + 8), (0x190000020, BASE + 0x20), (0x190000038, 0x190000010), (0x190000200, BASE + 4)}


def test_refusals(folder):
    whole = (folder / "cache.01").read_bytes()
    (folder / "cache.01").write_bytes(whole[:0x58] + bytes(16) + whole[0x68:])
    with pytest.raises(Refusal, match="Mismatch"):
        cache.Cache(str(folder / "cache"))
    (folder / "cache.01").write_bytes(whole[:-8])
    with pytest.raises(Refusal, match="past the end"):
        cache.Cache(str(folder / "cache"))
    (folder / "cache.01").unlink()
    with pytest.raises(Refusal, match="Io"):
        cache.Cache(str(folder / "cache"))
    for data in (b"", b"other", b"dyld_v1" + bytes(40)):
        (folder / "x").write_bytes(data)
        with pytest.raises(Refusal):
            cache.Cache(str(folder / "x"))
