"""The verbs: each asks the stores one question and answers with rows, verdict and coverage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import documents, fts, grep, lookup, stores
from factloom.plans.verdict import EMPTY, FOUND, NOT_VERIFIED, PARTIAL, Answer, Refusal, Verdict

CAP = 10


@dataclass
class Facts:
    """Tables of the fact layer; documents and disk stamps may be absent."""

    image: DataFrame
    coverage: DataFrame
    segment: DataFrame
    function: DataFrame
    call: DataFrame
    literal: DataFrame
    symbol: DataFrame
    virtual_call: DataFrame
    decompilation: DataFrame
    section: DataFrame | None = None
    citation: DataFrame | None = None
    seal: DataFrame | None = None
    file: DataFrame | None = None
    disk: DataFrame | None = None
    stale_config: bool = False
    #: Why the documents cannot be read, if they cannot.
    documents_problem: str | None = None
    #: (root, read, total) of the documents' collections.
    document_coverage: DataFrame | None = None
    #: Images whose pseudocode store is not complete, as (image_id).
    partial: DataFrame | None = None
    instruction: DataFrame | None = None
    #: (key, value) of the stores.
    meta: dict[str, str] = field(default_factory=dict)
    bytes: int | None = None

    @classmethod
    def projected(cls, projection) -> Facts:
        p = projection
        return cls(
            p.image, p.coverage, p.segment, p.function, p.call, p.literal, p.symbol, p.virtual_call, p.decompilation, p.section, documents.citations(p.cited_text),
            document_coverage=p.document_coverage, partial=p.partial, instruction=p.instr,
        )

    @classmethod
    def stored(cls, spark, store: str, documents_store: str | None = None, code: str | None = None, config_sha256: str | None = None, disk: DataFrame | None = None) -> Facts:
        """Over stores that builds made. Documents of another configuration are stale; without a documents or pseudocode store, that layer is not built."""
        from factloom.plans import builds
        from factloom.sources.stores import Store, disk_bytes

        catalogue = Store(spark, store, "Catalog")
        image = catalogue.table("image").withColumn("name", F.concat(F.substring_index("path", "/", -1), F.lit(".db")))
        rows, complete = builds.pseudocode(spark, code) if code else (spark.createDataFrame([], builds.DECOMPILED), True)
        out = cls(
            image, *(catalogue.table(t) for t in ("coverage", "segment", "function", "call", "literal", "symbol", "virtual_call")), rows,
            partial=None if complete else rows.select("image_id").distinct(), instruction=catalogue.table("instruction"), meta=catalogue.meta, bytes=disk_bytes(spark, catalogue.path),
        )
        if documents_store:
            try:
                docs = Store(spark, documents_store, "Documents")
            except Refusal as e:  # absent, or of another form: not built; unreadable: not verified
                out.documents_problem = None if e.code in ("NotFound", "Mismatch") else str(e)
                return out
            out.section, out.citation, out.file, out.document_coverage = (docs.table(t) for t in ("section", "citation", "file", "coverage"))
            out.seal = docs.table("seal") if docs.has("seal") else None
            out.disk, out.stale_config = disk, config_sha256 is not None and docs.meta.get("ConfigSha256") != config_sha256
        return out


def shown(rows: DataFrame, order: list[str], line, full: bool) -> tuple[int, list[str]]:
    """(number of all rows, lines of the first CAP or all)."""
    count, top = lookup.capped(rows, order, CAP, full)
    return count.first()[0], [line(r) for r in top.toLocalIterator()]


def whole(f: Facts) -> tuple[int, int]:
    """Coverage of all finished images."""
    r = lookup.header(f.image, f.coverage).first()
    return r["read"], r["total"]


def of_documents(f: Facts) -> tuple[int, int]:
    """Coverage of all collections of the documents."""
    r = documents.coverage(f.document_coverage).first()
    return r["read"], r["total"]


def of_count(count: int, read: int, total: int) -> Verdict:
    return Verdict(FOUND if count else EMPTY, count, read=read, total=total)


def header(f: Facts) -> str:
    r = lookup.header(f.image, f.coverage).first()
    return f"facts: {r['images']} images, coverage {r['read']}/{r['total']}"


def callers(f: Facts, address: int, full: bool = False) -> Answer:
    rows = lookup.callers(f.call, f.image, address)
    count, lines = shown(rows, ["path", "site"], caller_line, full)
    return Answer(of_count(count, *whole(f)), rows, lines)


def caller_line(r) -> str:
    island = f"  island {r['island']:#x}" if r["via"] == "Island" else ""
    return f"  {r['site']:#x}  in {r['caller']:#x}  {r['path'].rsplit('/', 1)[-1]}  {r['via']}{island}"


def owner(f: Facts, address: int):
    """The image row that owns an address, None for mapped data without an owner; unmapped is refused."""
    at = f.segment.where((F.col("address") <= address) & (F.col("address") + F.col("size") > address))
    held = at.join(f.image.select("image_id", "facts_state"), "image_id").orderBy("path").collect()  # segments around one address
    if not held:
        raise Refusal("NotFound", "find owner", f"{address:#x}", "the address is not mapped")
    return next((r for r in held if r["name"] != "__LINKEDIT"), None)


def image_coverage(f: Facts, path: str) -> tuple[int, int]:
    r = lookup.image_coverage(f.image.where(F.col("path") == path), f.coverage).first()
    return r["read"], r["total"]


def in_owner(f: Facts, address: int, ask) -> Answer:
    """ask(owner row) within the image that owns the address."""
    try:
        row = owner(f, address)
    except Refusal as e:
        return Answer(Verdict(NOT_VERIFIED, why=str(e)))
    if row is None:
        return Answer(Verdict(EMPTY), output=["owner: global data"])
    if row["facts_state"] != "FactsDone":
        return Answer(Verdict(PARTIAL, why=f"image {row['path']} not built"))
    return ask(row)


def calls(f: Facts, address: int, full: bool = False) -> Answer:
    def ask(row) -> Answer:
        if f.function.where((F.col("image_id") == row["image_id"]) & (F.col("address") == address)).isEmpty():
            return Answer(Verdict(NOT_VERIFIED, why=f"{address:#x} is not a function start"))
        rows = lookup.callees(f.call.where(F.col("image_id") == row["image_id"]), address)
        count, lines = shown(rows, ["site"], lambda r: f"  {r['site']:#x} -> {r['target']:#x}  {r['via']}", full)
        return Answer(of_count(count, *image_coverage(f, row["path"])), rows, lines)

    return in_owner(f, address, ask)


def refs(f: Facts, address: int, end: int | None = None, full: bool = False) -> Answer:
    def ask(row) -> Answer:
        rows = lookup.references(f.literal, address, end, row["image_id"])
        count, lines = shown(rows, ["site"], lambda r: f"  {r['site']:#x}  {r['kind']} {r['target']:#x}" + (f"  = {r['value']!r}" if r["value"] is not None else ""), full)
        return Answer(of_count(count, *image_coverage(f, row["path"])), rows, lines)

    return in_owner(f, address, ask)


def vcall(f: Facts, site: int, full: bool = False) -> Answer:
    def ask(row) -> Answer:
        rows = lookup.family(f.virtual_call, site)
        count, lines = shown(rows, ["candidate"], lambda r: f"  {r['candidate']:#x}  {r['candidate_symbol']}", full)
        if count:
            first = rows.orderBy("candidate").first()
            lines.insert(0, f"slot {first['slot_offset']:#x}  discriminator {first['discriminator']:#x}  {first['resolver']}")
        return Answer(of_count(count, *image_coverage(f, row["path"])), rows, lines)

    return in_owner(f, site, ask)


def containing(f: Facts, address: int):
    """(image row, function row) of the first finished image, by path, whose function holds the address."""
    at = f.function.where((F.col("address") <= address) & (F.col("size") != 0) & (F.col("address") + F.col("size") > address))
    return at.join(lookup.done(f.image).select("image_id", "path"), "image_id").orderBy("path", F.desc("address")).first()


def fn(f: Facts, address: int, asm: bool = False, full: bool = False) -> Answer:
    """Pseudocode of the function that holds an address, cells of islands named and counted; asm: its instructions."""
    row = containing(f, address)
    if row is None:
        return Answer(of_count(0, *whole(f)))
    start, name = row["address"], row["path"].rsplit("/", 1)[-1]
    head = f"{address:#x} is in {start:#x} (+{address - start:#x}), {row['size']} bytes, in {name}"
    if asm:
        return disassembly(f, row, head)
    own = f.decompilation.where(F.col("image_id") == row["image_id"])
    done = stores.pseudocode_coverage(own).first()
    text = own.where((F.col("function") == start) & F.col("pseudocode").isNotNull()).first()
    if text is None:
        return Answer(Verdict(EMPTY, read=done["ok"], total=done["attempted"]), output=[head, "no pseudocode of this function"])
    islands = lookup.resolve_islands(f.call.where((F.col("caller") == start) & F.col("island").isNotNull()), f.segment, f.symbol)
    body, named, bare, listed = text["pseudocode"], 0, 0, []
    for r in islands.orderBy("island").toLocalIterator():  # the islands of one function
        mark = f"MEMORY[0x{r['island']:X}]"
        if r["symbol"] is None:
            bare += mark in body
        else:
            named += mark in body
            body = body.replace(mark, r["symbol"])
        listed.append(f"  island {r['island']:#x} -> {r['target']:#x}  {r['symbol'] or '-'}  {r['path'].rsplit('/', 1)[-1]}")
    lines = body.split("\n")
    trailer = [f"islands: {named} named, {bare} without a symbol, {len(listed)} in all", f"cells left: {body.count('MEMORY[0x')}"] + (listed if full else [])
    return Answer(Verdict(FOUND, len(lines), read=done["ok"], total=done["attempted"]), output=[head, *lines, *trailer])


def disassembly(f: Facts, row, head: str) -> Answer:
    """The instructions of one function; coverage is decoded words of all its words."""
    if f.instruction is None:
        return Answer(Verdict(NOT_VERIFIED, why="the store holds no instructions"), output=[head])
    code = f.instruction.where((F.col("image_id") == row["image_id"]) & (F.col("va") >= row["address"]) & (F.col("va") < row["address"] + row["size"]))
    rows = code.where("mnemonic IS NOT NULL").orderBy("va")
    lines = [f"  {r['va']:#x}  {r['mnemonic']} {r['operands']}".rstrip() for r in rows.toLocalIterator()]  # one function's
    total = row["size"] // 4
    return Answer(of_count(len(lines), len(lines), total), rows, [head, *lines, f"layer 1: {len(lines)}/{total} instruction words decoded"])


def search(f: Facts, pattern: str, images: list[str] | None = None, ignore_case: bool = False, limit: int = 200) -> Answer:
    """Lines with a pattern over all images chosen, and what of them was not looked at. limit 0: all hits, which stream from the rows and are not gathered."""
    if not pattern:
        return Answer(Verdict(NOT_VERIFIED, why="the pattern is empty"))
    chosen, unknown = lookup_images(f, images)
    if unknown:
        known = [r[0] for r in f.image.select(F.substring_index("path", "/", -1).alias("n")).distinct().orderBy("n").limit(CAP).collect()]
        return Answer(Verdict(NOT_VERIFIED, why=f"unknown images: {', '.join(unknown)}; known are {', '.join(known)} and others"))
    own = f.decompilation.join(chosen.select("image_id"), "image_id", "left_semi")
    crossing = lookup.island_symbols(f.call, f.segment, f.symbol)
    hits = grep.limited(grep.grep(own, pattern, crossing, ignore_case), chosen, limit)
    top = hits.collect() if limit else []  # limit + 1 rows at most
    stop = top[limit]["path"] if limit and len(top) > limit else None
    found = len(top[:limit]) if limit else hits.count()
    through = sum(r["via_island"] for r in top[:limit]) if limit else hits.where("via_island").count()
    seen = grep.searched(chosen, own, f.call, f.partial, stop)
    count = grep.accounting(seen).first()

    def named(kind: str) -> str:
        return " ".join(r["path"].rsplit("/", 1)[-1] for r in seen.where(F.col("fate") == kind).orderBy("path").collect())  # images of one catalogue

    lines = [hit_line(r) for r in top[:limit]]
    lines += [f"stopped at {limit} hit(s); the rest is not searched"] if stop is not None else []
    lines += [f"not searched: {named(grep.NOT_SEARCHED)} -- no pseudocode there"] if count["not_searched"] else []
    lines += [f"not reached: {named(grep.NOT_REACHED)} -- the limit stopped the search before these"] if count["not_reached"] else []
    lines += [f"partial: {r['path'].rsplit('/', 1)[-1]} ({r['functions']} function(s) so far)" for r in seen.where("partial").orderBy("path").collect()]
    lines += [f"{count['refused']} function(s) in the searched images carry no pseudocode"] if count["refused"] else []
    lines += [f"searched {count['functions']} function(s) in {count['searched']} image(s); {through} hit(s) through islands"]
    lines += [f"{count['unindexed']} image(s) had no calls to resolve islands with"] if count["unindexed"] else []
    stream = None if limit else (hit_line(r) for r in hits.toLocalIterator())
    return Answer(of_count(found, count["searched"], count["selected"]), hits, lines, stream)


def hit_line(r) -> str:
    return f"  {r['path'].rsplit('/', 1)[-1]} {r['function']:#x}:{r['line']}: {r['text']}"


def lookup_images(f: Facts, images: list[str] | None) -> tuple[DataFrame, list[str]]:
    return grep.selected_images(f.image, [n for group in images for n in group.split(",") if n] if images else None)


def documents_block(f: Facts, address: int) -> list[str]:
    """Cited by and sealed at, each counted, or one line why not."""
    if f.documents_problem:
        return [f"documents: NOT VERIFIED {f.documents_problem}"]
    if f.citation is None or f.section is None:
        return ["documents: not built"]
    if f.stale_config:
        return ["documents: stale, the configuration has changed"]
    out = []
    for name, rows, all_rows in (("cited by", documents.cited_by(f.citation, f.section, address), f.citation), ("sealed at", None if f.seal is None else f.seal.where(F.col("address") == address), f.seal)):
        if rows is None:
            continue
        count, lines = shown(rows, ["file"], lambda r: f"  {r['file']}", False)
        blind = documents.blind_spot(all_rows, address).first()["blind"] if not count else None
        out += [f"{name}: {count}" + (f" (blind spot: {blind} rows without an address)" if blind else ""), *lines]
    return out


def question(f: Facts, what: str, full: bool = False) -> Answer:
    """All that is known of an address or a symbol."""
    output = [header(f)]
    if what.lower().startswith("0x"):
        try:
            address = int(what, 16)
        except ValueError:
            return Answer(Verdict(NOT_VERIFIED, why=f"{what} is no address"))
    else:
        found = lookup.symbol_addresses(f.symbol, f.image, what).first()
        if found is None:
            return Answer(of_count(0, *whole(f)), output=output)
        address = found["address"]
    output += documents_block(f, address)

    def ask(row) -> Answer:
        output.append(f"owner: {row['path']} {row['name']}")
        at = containing(f, address)
        if at is not None:
            names = f.symbol.where(F.col("address") == at["address"]).agg(F.min("name")).first()[0]
            output.append(f"function: {at['address']:#x} +{address - at['address']:#x}  {names or '-'}")
            n, lines = shown(lookup.callees(f.call, at["address"]), ["site"], lambda r: f"  {r['site']:#x} -> {r['target']:#x}  {r['via']}", full)
            output.extend([f"callees: {n}", *lines])
        scan = callers(f, address, full)
        output.extend([f"callers: {scan.verdict.count}", *scan.output])
        v = scan.verdict
        return Answer(Verdict(FOUND, 1, read=v.read, total=v.total) if at is not None else v, scan.rows, output)

    answer = in_owner(f, address, ask)
    return answer if answer.output is output else Answer(answer.verdict, answer.rows, output + answer.output)


def find(f: Facts, text: str) -> Answer:
    if f.section is None:
        return Answer(Verdict(NOT_VERIFIED, why=f.documents_problem or "documents are not built"))
    if fts.too_short(text):
        return Answer(Verdict(NOT_VERIFIED, why="fewer than three characters to look up"))
    try:
        hits = fts.find(f.section, text)
    except fts.QueryError as e:
        return Answer(Verdict(NOT_VERIFIED, why=f"not a query: {e}"))
    rows = hits.join(f.section.select("id", "file", "number", "title"), "id")
    counted, top = lookup.capped(rows, ["rank", "id"], CAP)
    shown_rows = top.collect()  # CAP rows
    stale = set() if f.disk is None else {r["path"] for r in changed_files(f).where(F.col("path").isin([r["file"] for r in shown_rows])).collect()}
    lines = [f"  {r['file']} {r['number'] or '—'} {r['title']}{' [stale]' if r['file'] in stale or f.stale_config else ''}\n    {r['snippet']}" for r in shown_rows]
    return Answer(of_count(counted.first()[0], *of_documents(f)), rows, lines)


def changed_files(f: Facts) -> DataFrame:
    return stores.staleness(f.file, f.disk)


def laudo(f: Facts, slug: str, part: str | None = None) -> Answer:
    """The outline of a document, or one of its sections."""
    if f.section is None:
        return Answer(Verdict(NOT_VERIFIED, why=f.documents_problem or "documents are not built"))
    files = [r["file"] for r in documents.files_of_slug(f.section, slug).collect()]
    if len(files) > 1:
        return Answer(Verdict(NOT_VERIFIED, why=f"{slug} is ambiguous: {', '.join(files)}"))
    read, total = of_documents(f)
    if not files:
        return Answer(Verdict(EMPTY, read=read, total=total))
    stale = f.stale_config or f.disk is not None and not changed_files(f).where(F.col("path") == files[0]).isEmpty()
    if part is None:
        rows = documents.outline(f.section, slug).orderBy("first_line")
        lines = [f"  {r['number'] or '—'}  {r['title']}  ({r['n_lines']} lines)" for r in rows.toLocalIterator()]
        return Answer(Verdict(FOUND, len(lines), read=read, total=total), rows, ["stale: the file has changed"] * stale + lines)
    if stale:
        return Answer(Verdict(NOT_VERIFIED, why=f"{files[0]} has changed since it was read"))
    wanted = part.removeprefix("Â§").removeprefix("§")
    rows = documents.section_by_number(f.section, files[0], wanted) if wanted and all(c in "0123456789." for c in wanted) else documents.section_by_title(f.section, files[0], wanted)
    row = rows.first()
    return Answer(of_count(int(row is not None), read, total), rows, [row["text"]] if row else [])


def status(f: Facts) -> Answer:
    """State and coverage of every image, pseudocode, documents and changed files; always found, even with no image."""
    done = lookup.done(f.image).count()
    lines = [f"  {r['path']}  {r['facts_state']}  {r['read']}/{r['total']}" for r in lookup.image_coverage(f.image, f.coverage).orderBy("path").toLocalIterator()]
    code = stores.pseudocode_coverage(f.decompilation).first()
    lines = [f"  {k}: {v}" for k, v in sorted(f.meta.items())] + lines + ([f"store: {f.bytes} bytes"] if f.bytes is not None else [])
    lines.append(f"pseudocode: {code['ok']} of {code['attempted']} functions, {code['lines']} lines, {code['too_big']} refused for size")
    for name in ("section", "citation", "seal"):
        table = getattr(f, name)
        lines.append(f"{name}: " + ("not built" if table is None else str(table.count())))
    if f.file is not None and f.disk is not None:
        fates = {r["fate"]: r["count"] for r in changed_files(f).groupBy("fate").count().collect()}
        lines.append(", ".join(f"{k}: {fates.get(k, 0)}" for k in ("changed", "added", "removed")))
    return Answer(Verdict(FOUND, done, read=whole(f)[0], total=whole(f)[1]), output=lines)
