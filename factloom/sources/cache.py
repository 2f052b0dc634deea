"""A split shared cache: one address space over a main file and its subcaches, with chained pointers.

The header is read on the driver; pointers of all pages are decoded by tasks, each of which opens the files by their path: the folder must be one that all machines see.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from factloom.functions.binary import POINTER_MASK
from factloom.plans.verdict import Refusal
from factloom.sources.macho import CACHE_MAGIC, Malformed, take, text_at

#: Places in the header and marks of the format (fixed values).
MAPPINGS, UUID, SLIDE_MAPPINGS, SUBCACHES, SYMBOL_UUID, IMAGES, HEADER_END = 0x10, 0x58, 0x138, 0x188, 0x190, 0x1C0, 0x1C8
SLIDE_VERSION, NO_REBASE, DELTA_SHIFT, DELTA_MASK = 5, 0xFFFF, 52, 0x7FF
HEADER_BYTES, PAGES = 1 << 20, 512


@dataclass(frozen=True)
class Slide:
    version: int
    page_size: int
    value_add: int
    starts_at: int
    starts: int


@dataclass(frozen=True)
class Mapping:
    file: str
    address: int
    size: int
    offset: int
    slide: Slide | None = None


def refused(code: str, operation: str, va: int, reason: str, action: str, verified: bool = False) -> Refusal:
    return Refusal(code, operation, f"{va:#x}", reason, action, verified)


def head(path: Path, size: int = HEADER_BYTES) -> bytes:
    try:
        with path.open("rb") as f:
            return f.read(size)
    except OSError as e:
        raise Refusal("Io", "open cache", str(path), str(e)) from None


def at(path: str, offset: int, size: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(offset)
        return f.read(size)


def file_mappings(path: Path) -> list[Mapping]:
    """The mappings of one file that hold something, with their slide tables if it lists one for each."""
    data, total = head(path), path.stat().st_size
    where, count = take(data, "2I", MAPPINGS)
    slides, n_slides = take(data, "2I", SLIDE_MAPPINGS) if where > SLIDE_MAPPINGS else (0, 0)
    out = []
    for k in range(count):
        slide = None
        if slides and n_slides == count:
            address, size, offset, info, info_size = take(data, "5Q", slides + 56 * k)
            if info_size:
                version, page, starts, _, add = take(at(str(path), info, 24), "4IQ", 0)
                slide = Slide(version, page, add, info + 24, starts)
        else:
            address, size, offset = take(data, "3Q", where + 32 * k)
        if offset > total or total - offset < size:
            raise Malformed(f"{path}: the mapping at {address:#x} runs past the end of the file")
        if size:
            out.append(Mapping(str(path), address, size, offset, slide))
    return out


class Cache:
    """An opened cache. Files of another cache, old headers and truncated ones are refused."""

    def __init__(self, main: str):
        path = Path(main)
        data = head(path)
        if not data.startswith(CACHE_MAGIC):
            raise Refusal("Unsupported", "open cache", main, "the file does not carry the cache's magic", "point at the main file of a shared cache")
        try:
            if take(data, "I", MAPPINGS)[0] <= HEADER_END:
                raise Refusal("Unsupported", "open cache", main, "the header is older than suffixed subcaches")
            self.uuid = self.uuid_of(data)
            (where, count), (images, n_images) = take(data, "2I", SUBCACHES), take(data, "2I", IMAGES)
            self.images = [(text_at(data, take(data, "I", images + 32 * k + 24)[0]), take(data, "Q", images + 32 * k)[0]) for k in range(n_images)]
            files = [path]
            for k in range(count):
                entry = where + 56 * k
                files.append(self.part(path, text_at(data, entry + 24, 32), bytes(take(data, "16B", entry)).hex()))
            symbols = bytes(take(data, "16B", SYMBOL_UUID)).hex()
            if symbols != "0" * 32:
                self.part(path, ".symbols", symbols)
            found = sorted((m for f in files for m in file_mappings(f)), key=lambda m: (m.address, m.size))
        except Malformed as e:
            raise Refusal("Malformed", "open cache", main, str(e), "extract the cache again") from None
        self.mappings = [m for k, m in enumerate(found) if not k or (m.address, m.size) != (found[k - 1].address, found[k - 1].size)]
        self.starts = [m.address for m in self.mappings]

    @staticmethod
    def uuid_of(data: bytes) -> str:
        return bytes(take(data, "16B", UUID)).hex()

    def part(self, main: Path, suffix: str, uuid: str) -> Path:
        path = main.with_name(main.name + suffix)
        if (own := self.uuid_of(head(path, UUID + 16))) != uuid:
            raise Refusal("Mismatch", "open cache", str(path), f"its uuid {own} is not {uuid}, which the main file names", "extract the cache again")
        return path

    def find(self, va: int) -> Mapping | None:
        k = bisect_right(self.starts, va) - 1
        return self.mappings[k] if k >= 0 and va - self.starts[k] < self.mappings[k].size else None

    def mapped(self, va: int) -> bool:
        return self.find(va) is not None

    def read(self, va: int, size: int) -> bytes:
        """Bytes at an address; a read never crosses the end of a mapping."""
        m = self.find(va)
        if m is None:
            raise refused("NotFound", "read cache", va, "no mapping holds the address", "ask for an address of the cache")
        if m.size - (va - m.address) < size:
            raise refused("NotFound", "read cache", va, f"{size} bytes cross the end of the mapping", "read less")
        return at(m.file, m.offset + va - m.address, size)

    def slide(self, slot: int, operation: str) -> tuple[Mapping, Slide]:
        m = self.find(slot)
        if m is None:
            raise refused("NotFound", operation, slot, "no mapping holds the slot", "ask for an address of the cache")
        if m.slide is None:
            raise refused("Unsupported", operation, slot, "the mapping carries no slide table", "ask for a data address")
        if m.slide.version != SLIDE_VERSION:
            raise refused("Unsupported", operation, slot, f"slide tables of version {m.slide.version} are not read")
        if not m.slide.page_size:
            raise refused("Malformed", operation, slot, "the slide table has pages of no size", "extract the cache again")
        return m, m.slide

    def pointer(self, slot: int) -> int:
        """The address that a slot points to; a raw zero and a target outside the cache are refused."""
        _, s = self.slide(slot, "decode pointer")
        raw = int.from_bytes(self.read(slot, 8), "little")
        if not raw:
            raise refused("NotFound", "decode pointer", slot, "the slot holds zero", "", True)
        target = s.value_add + (raw & POINTER_MASK)
        if not self.mapped(target):
            raise refused("NotFound", "decode pointer", slot, f"its target {target:#x} is not mapped", "the slot holds data", True)
        return target

    def rebased(self, slot: int) -> bool:
        """Is a slot a link of its page's chain?"""
        m, s = self.slide(slot, "follow chain")
        page = (slot - m.address) // s.page_size
        if page >= s.starts:
            return False
        first = int.from_bytes(at(m.file, s.starts_at + 2 * page, 2), "little")
        start = page * s.page_size
        return slot - m.address - start in dict(chain(at(m.file, m.offset + start, min(s.page_size, m.size - start)), first))


def chain(page: bytes, first: int) -> list[tuple[int, int]]:
    """(place, raw value) of the links of one page, from where its first link is."""
    out = []
    if first != NO_REBASE:
        link = first // 8 * 8
        while link + 8 <= len(page):
            raw = int.from_bytes(page[link : link + 8], "little")
            out.append((link, raw))
            delta = raw >> DELTA_SHIFT & DELTA_MASK
            if not delta:
                break
            link += 8 * delta
    return out


def cells(spark: SparkSession, cache: Cache) -> DataFrame:
    """(at, target) of every chained pointer into the cache: runs of pages are dealt over tasks, which read them from the files."""
    runs = [(m.file, m.address, m.offset, m.size, s.page_size, s.value_add, s.starts_at, page, min(page + PAGES, s.starts)) for m in cache.mappings if (s := m.slide) and s.version == SLIDE_VERSION and s.page_size for page in range(0, s.starts, PAGES)]
    spans = [(m.address, m.address + m.size) for m in cache.mappings]
    names = "file string, address long, offset long, size long, page_size long, value_add long, starts_at long, page long, last long"

    def walk(frames):
        starts = [a for a, _ in spans]
        for f in frames:
            for r in f.itertuples(index=False):
                firsts, rows = at(r.file, r.starts_at + 2 * r.page, 2 * (r.last - r.page)), []
                for page in range(r.page, r.last):
                    start = page * r.page_size
                    first = int.from_bytes(firsts[2 * (page - r.page) : 2 * (page - r.page) + 2], "little")
                    for link, raw in chain(at(r.file, r.offset + start, max(0, min(r.page_size, r.size - start))), first):
                        target = r.value_add + (raw & POINTER_MASK)
                        k = bisect_right(starts, target) - 1
                        if raw and k >= 0 and target < spans[k][1]:
                            rows.append((r.address + start + link, target))
                yield pd.DataFrame(rows, columns=["at", "target"])

    if not runs:
        return spark.createDataFrame([], "at long, target long")
    return spark.createDataFrame(runs, names).repartition(len(runs)).mapInPandas(walk, "at long, target long")
