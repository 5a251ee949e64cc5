"""Chunks of source files: cut at declarations and blank lines outside brackets, with context, overlap and a byte budget.

All is found by offsets in a file's UTF-8 bytes. The depth of brackets, which never falls under zero, is the running sum
of brackets less the least it has been, so no line is looked at one by one. Files are rows of Arrow batches; a batch's
chunks come out as batches too, and no line or chunk is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import languages as L
from corpusloom.operators.chunking import BLANK, SPACE, gathered, packed_cuts, paragraph_ends

_DECLARATION = re.compile(L.declaration_pattern(SPACE.decode("latin-1")).encode("latin-1"), re.I | re.M)
_IMPORT = re.compile(L.import_pattern(SPACE.decode("latin-1")).encode("latin-1"), re.I | re.M)
_QUOTED = re.compile("""["'<]([^"'>]+)["'>]""")
_TRIM = "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
_NET = np.zeros(256, np.int8)
_NET[list(b"({[")] = 1
_NET[list(b")}]")] = -1
#: What an entity's kind is called; other declaring words declare functions.
KINDS = dict.fromkeys("class struct record module namespace trait impl entity architecture package component".split(), "class") | {k: k for k in ("interface", "enum", "type", "method")}
#: Characters (UTF-16 units) kept of a signature and of an import that names nothing in quotes.
SIGNATURE, IMPORTED = 240, 120


@dataclass(frozen=True)
class Options:
    """most: bytes of a chunk. context: full, minimal (no imports) or none. siblings: signatures, names or none."""

    most: int = 1024
    context: str = "full"
    siblings: str = "signatures"
    used_imports: bool = False
    overlap: float = 0.2


def line_ends(raw: np.ndarray) -> np.ndarray:
    """Ends of the lines of a non-empty text, each with its \\n; an empty line behind the last \\n isn't one."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if ends.size and ends[-1] == raw.size else np.append(ends, raw.size)


def depths(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Depth of brackets behind each line: it moves by the line's openings less closings, but never under 0."""
    net = _NET[raw]
    places = np.flatnonzero(net)
    total = np.concatenate([[0], np.cumsum(net[places], dtype=np.int64)])[np.searchsorted(places, ends)]
    return total - np.minimum(np.minimum.accumulate(total), 0)


def block_ends(data: bytes, raw: np.ndarray) -> np.ndarray:
    """Ends of a text's blocks: before declarations and behind blank lines, where no bracket is open, and at the end."""
    ends = line_ends(raw)
    depth = depths(raw, ends)
    declared = np.array([m.start() for m in _DECLARATION.finditer(data)], np.int64)
    line = np.searchsorted(ends, declared, "right")
    declared = declared[(declared > 0) & (depth[np.maximum(line, 1) - 1] == 0)]
    blank = np.array([m.end() for m in BLANK.finditer(data) if m.end() > m.start()], np.int64)
    blank = blank[depth[np.searchsorted(ends, blank)] == 0]
    return np.unique(np.concatenate([declared, blank, [raw.size]]))


def _cut(text: str, units: int) -> str:
    """The first so many UTF-16 units of a text."""
    return text[:units] if text[:units].isascii() else text.encode("utf-16-le")[: 2 * units].decode("utf-16-le", "replace")


@dataclass
class Entities:
    """Declarations and imports of a file, by line: byte offsets (start, end), name, kind, signature."""

    starts: np.ndarray
    ends: np.ndarray
    names: list[str]
    kinds: list[str]
    signatures: list[str]
    imports: list[str]


def entities(data: bytes, raw: np.ndarray) -> Entities:
    ends = line_ends(raw)
    found = list(_DECLARATION.finditer(data))
    starts = np.array([m.start() for m in found], np.int64)
    upto = ends[np.searchsorted(ends, starts, "right")] if found else starts
    lines = lambda lo, hi: [data[x:y].decode().strip(_TRIM) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
    imported = np.array([m.start() for m in _IMPORT.finditer(data)], np.int64)
    imports = []
    for text in lines(imported, ends[np.searchsorted(ends, imported, "right")]):
        quoted = _QUOTED.search(text)
        imports.append(quoted[1] if quoted else _cut(text, IMPORTED))
    kinds = [KINDS.get(m[1].decode().lower(), "function") for m in found]
    return Entities(starts, upto, [m[2].decode() for m in found], kinds, [_cut(x, SIGNATURE) for x in lines(starts, upto)], imports)


def overlap_start(data: bytes, lo: int, hi: int, target: int) -> int:
    """Where the run of last whole lines of data[lo:hi] starts whose bytes come nearest to target; the longer one of two; hi for none."""
    if target <= 0 or hi <= lo:
        return hi
    raw = np.frombuffer(data, np.uint8, hi - lo, lo)
    starts = np.concatenate([[0], line_ends(raw)[:-1]])
    return lo + int(starts[np.argmin(np.abs(raw.size - starts - target))])


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def with_context(text: str, path: str, language: str, defines: list[str], uses: list[str], before: str | None, after: str | None, overlap: str, context: bool = True) -> str:
    """The text below what a reader should know: path, language, what it defines and uses, neighbours, the lines before it."""
    head = []
    if context:
        if path:
            head.append("# " + "/".join(path.split("/")[-3:]))
        if language:
            head.append(f"# Language: {language}")
        if defines:
            head.append("# Defines: " + ", ".join(defines))
        if uses:
            head.append("# Uses: " + ", ".join(uses))
        if before is not None:
            head.append(f"# After: {before}")
        if after is not None:
            head.append(f"# Before: {after}")
        if head:
            head.append("")
    if overlap:
        head += ["# ...", overlap, "# ---"]
    return "\n".join([*head, text])


@dataclass
class Chunked:
    cuts: np.ndarray
    texts: list[str]
    contexts: list[str]

    def largest(self) -> int:
        return max((len(x.encode()) for x in self.contexts), default=0)


def chunk_file(path: str, data: bytes, language: str, strategy: str, options: Options) -> Chunked:
    """A file's chunks by strategy: logical-boundary (see block_ends) or plain-text (paragraphs), each with its context."""
    raw = np.frombuffer(data, np.uint8)
    if not raw.size:
        return Chunked(np.zeros(1, np.int64), [], [])
    logical = strategy == "logical-boundary"
    cuts = packed_cuts(raw, block_ends(data, raw) if logical else paragraph_ends(raw), options.most)
    known = entities(data, raw) if logical and options.context != "none" else None
    target = half_up(options.most * options.overlap)
    texts, contexts = [], []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        text = data[lo:hi].decode("utf-8", "replace")  # a cut inside a character only where chunks are shorter than that
        defines, uses, before, after = [], [], None, None
        if known:
            first, behind = np.searchsorted(known.starts, [lo, hi])
            defines = [s for s in known.signatures[first:behind] if s]
            if options.siblings != "none":
                last = int(np.searchsorted(known.ends, lo, "right")) - 1
                before = known.names[last] if last >= 0 else None
                after = known.names[behind] if behind < len(known.names) else None
            if options.context == "full":
                uses = [i for i in known.imports if not options.used_imports or i in text]
        previous = data[overlap_start(data, begin, lo, target) : lo].decode("utf-8", "replace") if texts else ""
        contexts.append(with_context(text, path, language, defines, uses, before, after, previous, options.context != "none"))
        texts.append(text)
        begin = lo
    return Chunked(cuts, texts, contexts)


def fit_file(path: str, data: bytes, language: str, strategy: str, options: Options, budget: int) -> tuple[Chunked, Options, int, str | None]:
    """chunk_file so that each chunk with its context has at most ``budget`` bytes: chunks, options, retries, error.

    If a chunk is larger the file is cut again, smaller by as much and a bit (128 bytes at least); if that won't do, once
    more with less context and no overlap. What still doesn't fit is given up: no chunks, and an error.
    """
    first = chunk_file(path, data, language, strategy, options)
    largest = first.largest()
    if largest <= budget:
        return first, options, 0, None
    scaled = replace(options, most=max(128, math.floor(options.most * (budget / largest) * 0.85)))
    second = chunk_file(path, data, language, strategy, scaled)
    if second.largest() <= budget:
        return second, scaled, 1, None
    bare = replace(scaled, context="minimal", siblings="names", overlap=0.0)
    third = chunk_file(path, data, language, strategy, bare)
    if third.largest() <= budget:
        return third, bare, 2, None
    return Chunked(np.zeros(1, np.int64), [], []), bare, 2, "embedding_input_too_large"


SCHEMA = (
    "doc_id long, chunk_index long, total_chunks long, byte_start long, byte_end long, line_start long, line_end long, chunk string,"
    " contextualized string, token_count long, strategy string, fallback_reason string, most long, retries long, error string"
)


def strategy_of(grammar: Column, detected_by: Column) -> tuple[Column, Column]:
    """How a file is cut and why not by its syntax: there are no parsers here, so files with a grammar fall back to their blocks."""
    strategy = F.when(grammar.isNotNull() | (detected_by != "plain-text"), "logical-boundary").otherwise("plain-text")
    return strategy, F.when(grammar.isNotNull(), F.concat(F.lit("missing_tree_sitter_grammar:"), grammar))


def chunk_sources(files: DataFrame, options: Options | None = None, budget: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Chunks (SCHEMA, and keep: columns of strings) of files: doc_id, path, text and what ``detect_sources`` adds.

    Chunks of a file follow each other without gaps; lines count from 1; token_count is the bytes of ``contextualized``.
    With a budget each file is fitted on its own (``fit_file``): ``most`` and ``retries`` tell how, and a file that
    can't be fitted is one row with an ``error`` and no chunk. Empty and null texts, and rows without doc_id, have none.
    """
    options, schema = options or Options(), ", ".join([SCHEMA, *(f"kept_{c} string" for c in keep)])
    strategy, reason = strategy_of(F.col("grammar"), F.col("detected_by"))
    rows = files.where("doc_id is not null").select("doc_id", F.coalesce("path", F.lit("")).alias("path"), "text", "language_id", strategy.alias("strategy"), reason.alias("reason"), *(F.col(c).alias(f"kept_{c}") for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(b: pa.RecordBatch, i: int, data: bytes) -> list[list]:
            path, language, how, why = (b.column(c)[i].as_py() for c in ("path", "language_id", "strategy", "reason"))
            if budget is None:
                got, used, retries, error = chunk_file(path, data, language, how, options), options, 0, None
            else:
                got, used, retries, error = fit_file(path, data, language, how, options, budget)
            n = len(got.texts)
            more = [[b.column(f"kept_{c}")[i].as_py()] * (1 if error else n) for c in keep]
            if error:
                return [[b.column("doc_id")[i].as_py()], [None], [0], [None], [None], [None], [None], [None], [None], [None], [how], [why], [used.most], [retries], [error], *more]
            breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
            lo, hi = got.cuts[:-1], got.cuts[1:]
            first, last = np.searchsorted(breaks, lo) + 1, np.searchsorted(breaks, hi - 1) + 1
            sizes = [len(x.encode()) for x in got.contexts]
            same = lambda x: [x] * n
            return [same(b.column("doc_id")[i].as_py()), list(range(n)), same(n), lo.tolist(), hi.tolist(), first.tolist(), last.tolist(), got.texts, got.contexts, sizes, same(how), same(why), same(used.most), same(retries), same(None), *more]

        yield from gathered(batches, each, schema)

    return rows.mapInArrow(run, schema).withColumnsRenamed({f"kept_{c}": c for c in keep})


def target_chunks(files: DataFrame, keep: list[str], most: int = 1024) -> DataFrame:
    """Chunks of files by their blocks (see ``chunk_sources``), without context: keep (strings), path, doc_id, chunk_index, text, asked.

    asked is the signature of the file's first declaration, in the chunk that holds it; null in all others.
    """
    schema = ", ".join([*(f"{c} string" for c in keep), "path string, doc_id long, chunk_index long, text string, asked string"])

    def each(b: pa.RecordBatch, i: int, data: bytes) -> list[list]:
        raw = np.frombuffer(data, np.uint8)
        cuts = packed_cuts(raw, block_ends(data, raw), most)
        first, asked = _DECLARATION.search(data), [None] * (cuts.size - 1)
        if first:
            end = data.find(b"\n", first.start())
            line = data[first.start() : end if end >= 0 else len(data)].decode().strip(_TRIM)
            asked[int(np.searchsorted(cuts, first.start(), "right")) - 1] = _cut(line, SIGNATURE)
        texts = [data[lo:hi].decode("utf-8", "replace") for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        same = [[b.column(c)[i].as_py()] * len(texts) for c in (*keep, "path", "doc_id")]
        return [*same, list(range(len(texts))), texts, asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(batches, each, schema)

    return files.where("doc_id is not null").select(*keep, "path", "doc_id", "text").mapInArrow(run, schema)


def logical_blocks(files: DataFrame) -> DataFrame:
    """doc_id, block (from 0), byte_start, byte_end: the blocks of every text before any is split or merged."""
    schema = "doc_id long, block long, byte_start long, byte_end long"

    def each(b: pa.RecordBatch, i: int, data: bytes) -> list[list]:
        ends = block_ends(data, np.frombuffer(data, np.uint8)).tolist()
        return [[b.column("doc_id")[i].as_py()] * len(ends), list(range(len(ends))), [0, *ends[:-1]], ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(batches, each, schema)

    return files.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, schema)


def file_entities(files: DataFrame) -> DataFrame:
    """doc_id, number (from 0), name, kind, signature, byte_start, byte_end of every declaration, in order."""
    schema = "doc_id long, number long, name string, kind string, signature string, byte_start long, byte_end long"

    def each(b: pa.RecordBatch, i: int, data: bytes) -> list[list]:
        e = entities(data, np.frombuffer(data, np.uint8))
        n = len(e.names)
        return [[b.column("doc_id")[i].as_py()] * n, list(range(n)), e.names, e.kinds, e.signatures, e.starts.tolist(), e.ends.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(batches, each, schema)

    return files.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, schema)


def file_imports(files: DataFrame) -> DataFrame:
    """doc_id, number (from 0), name of every import, in order: what stands in quotes, else the line."""
    schema = "doc_id long, number long, name string"

    def each(b: pa.RecordBatch, i: int, data: bytes) -> list[list]:
        names = entities(data, np.frombuffer(data, np.uint8)).imports
        return [[b.column("doc_id")[i].as_py()] * len(names), list(range(len(names))), names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(batches, each, schema)

    return files.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, schema)


def marked_imports(imports: DataFrame, known: DataFrame) -> DataFrame:
    """imports (doc_id, number, name) with used: whether a declaration (doc_id, name, signature) of the file has the name as a word."""
    words = F.regexp_extract_all(F.concat_ws(" ", "name", "signature"), F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))
    used = known.select("doc_id", F.explode(words).alias("name")).distinct().withColumn("used", F.lit(True))
    return imports.join(used, ["doc_id", "name"], "left").select("doc_id", "number", "name", F.coalesce("used", F.lit(False)).alias("used"))


def united_entities(tagged: DataFrame, walked: DataFrame) -> DataFrame:
    """tagged entities and those walked ones (both doc_id, kind, byte_start, byte_end, any others) whose kind and place no tagged one has."""
    key = ["doc_id", "byte_start", "byte_end", "kind"]
    return tagged.unionByName(walked.join(tagged.select(*key).distinct(), key, "left_anti").select(*tagged.columns))


def line_suffix(text: Column, target: Column) -> Column:
    """The run of last whole lines of a text whose bytes come nearest to target, the longer one of two; null for none.

    Lines stay in their row: their sizes are summed from the end in one array.
    """
    lines = F.filter(F.regexp_extract_all(text, F.lit("[^\\n]*(?:\\n|$)"), F.lit(0)), lambda x: x != "")
    sizes = F.reverse(F.transform(lines, F.octet_length))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("best"), F.lit(2**31 - 1).alias("far"))

    def step(s: Column, size: Column) -> Column:
        total, n = s["sum"] + size, s["n"] + 1
        far = F.abs(total - target)
        nearer = far <= s["far"]
        return F.struct(total.alias("sum"), n.alias("n"), F.when(nearer, n).otherwise(s["best"]).alias("best"), F.when(nearer, far).otherwise(s["far"]).alias("far"))

    best = F.aggregate(sizes, start, step)["best"]
    return F.when((target > 0) & (text != ""), F.array_join(F.slice(lines, -best, best), ""))


def with_overlap(chunks: DataFrame, key: list[str], order: str, most: int = 1024, ratio: float = 0.2) -> DataFrame:
    """chunks (key, order, text, header) with overlap (lines of the chunk before it, null for none) and contextualized.

    For chunks that come as rows, from whatever chunker: a chunk's text follows its header (null: none) and the lines.
    A window by key; only the neighbours' last lines move, as the overlap is found before it.
    """
    last = line_suffix(F.coalesce("text", F.lit("")), F.lit(half_up(most * ratio)))
    w = Window.partitionBy(*key).orderBy(order)
    cut = chunks.withColumn("_last", last).withColumn("overlap", F.lag("_last").over(w)).drop("_last")
    lines = F.when(F.coalesce(F.col("overlap"), F.lit("")) != "", F.concat(F.lit("# ...\n"), "overlap", F.lit("\n# ---")))
    head = F.when(F.col("header").isNotNull(), F.concat("header", F.lit("\n")))
    return cut.withColumn("contextualized", F.concat_ws("\n", head, lines, F.coalesce("text", F.lit(""))))
