"""Source divergence audit: how the terms of each source of a language differ from other sources' and the language's.

Plain relational: explode the matches of an expression, group counts, cross the groups with the kept vocabulary so that
zeros count, join on language and term, sum, rank. Whole numbers only, so results don't depend on the order of sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, partitions, pieces, scratch

#: A term is a run of ASCII's letters and of what is above ASCII, [^\x00-\x40\x5B-\x60\x7B-\x7F]+; in UTF-8 these bytes, A-Z lower-cased.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Lower-cases A-Z and puts a blank for every byte that is in no term, so that what lies between blanks are the matches.
_SPREAD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A task's counts are given out when it has so many; texts of more bytes are not split into a list.
HELD, LONG = 200_000, 1 << 22
#: Parts of a thousand million.
SCALE = 1_000_000_000


def term_counts(docs: DataFrame, held: int = HELD, long: int = LONG) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows of that group with the term); each row of docs is a document.

    A task counts the matches of its rows by group and gives out what it has, as often as it holds ``held`` terms; so no
    match and no (document, term) pair is shuffled, and memory is that of one text and ``held`` counts.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    schema = "lang string, source string, term string, n long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in counts.items():
                cols = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
            counts.clear()

        for b in pieces(batches, "text"):
            texts = b.column("text").cast(pa.binary())
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts, strict=True):
                data = text.as_py().translate(_SPREAD)
                n, d = counts.setdefault((lang, source), (Counter(), Counter()))
                if len(data) <= long:
                    found = data.split()
                    n.update(found)
                    d.update(set(found))
                else:
                    found = Counter(m[0] for m in TERM.finditer(data))
                    n.update(found)
                    d.update(list(found))
            if sum(len(n) for n, _ in counts.values()) >= held:
                yield from told()
        yield from told()

    counted = rows.mapInArrow(run, schema)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)); beyond what a long holds by decimals, which divide exactly too."""
    whole, wide = (n + 1) * SCALE, (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    plain, exact = F.call_function("div", whole, total + kept), F.call_function("div", wide, (total + kept).cast("decimal(20,0)"))
    return F.lit(1) + F.when(n < 9_000_000_000, plain).otherwise(exact)


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit_sources(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank for docs (text, lang, source; nulls count as empty).

    A language keeps the terms of at least ``least`` of its documents. p: a term's share in a group, in parts of a
    thousand million, plus one. Part ``pair``: item another source of the language, value the sum of (p-q)(p-q)/q over
    all kept terms, q the other's. Part ``term``: item a kept term the group has more often than its language (p > q),
    value that term's, the ``top`` highest. Ranks go from 1, by value falling, then item. A language that keeps no term
    has pairs of value 0. No documents, no rows; equal rows count each. Group sizes and vocabulary sizes are joined to
    rows by language under a salt, so that a language with most terms is spread over tasks; terms and groups are joined
    by numbers of their own.
    """
    n_parts = partitions(docs.sparkSession)
    number = F.monotonically_increasing_id()  # written with its row, so it stays
    with scratch() as keep:
        counts = materialize(term_counts(docs), "term-counts")
        named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
        groups = materialize(named.withColumn("gid", number), "term-groups")
        by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        kept = materialize(by_term.where(F.col("docs") >= least).drop("docs").withColumn("tid", number), "kept-terms")
        held = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]).join(groups, ["lang", "source"])
        held = materialize(held.select("tid", "gid", "term", "n", "lang_n"), "held-terms")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
        totals = held.groupBy("gid").agg(F.sum("n").alias("total"))
        sized = groups.join(langs, "lang").join(totals, "gid", "left").select("gid", "lang", F.coalesce("total", F.lit(0)).alias("total"), "kept", "lang_total")
        sized = materialize(sized, "group-sizes")
        p, q = _share(F.col("n"), F.col("total"), F.col("kept")), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))

        # Each group with each term its language keeps, whether it has it or not.
        salts = sized.select("gid", "lang", "total", "kept", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("_salt"))
        spread = kept.select("tid", "lang", F.pmod(F.xxhash64("tid"), F.lit(n_parts)).cast("int").alias("_salt"))
        cells = spread.join(salts, ["lang", "_salt"]).join(held.select("tid", "gid", "n"), ["tid", "gid"], "left")
        shares = materialize(cells.withColumn("n", F.coalesce("n", F.lit(0))).select("tid", "gid", p.alias("p")), "term-shares")

        a, b = shares.alias("a"), shares.alias("b")  # the same rows: one shuffle serves both sides
        gaps = a.join(b, F.col("a.tid") == F.col("b.tid")).where(F.col("a.gid") != F.col("b.gid"))
        sums = gaps.select(F.col("a.gid").alias("gid"), F.col("b.gid").alias("other"), _gap(F.col("a.p"), F.col("b.p")).alias("f")).groupBy("gid", "other").agg(F.sum("f").alias("value"))
        every = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("other")), "lang").where(F.col("gid") != F.col("other"))
        pairs = every.join(sums, ["gid", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
        more = held.join(sized.drop("lang"), "gid").select("gid", "term", p.alias("p"), q.alias("q")).where(F.col("p") > F.col("q"))
        stand_out = more.select("gid", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))

        order = [F.col("value").desc(), F.col("item").asc()]
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
        best = stand_out.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(*order))).where(F.col("rank") <= top)
        best = best.join(groups, "gid").select("lang", "source", "part", "item", "value", "rank")
        out = materialize(ranked.select(*best.columns).unionByName(best), "divergence")
        keep.append(out)
    return out
