"""Quality classifier: an interpolated modified Kneser-Ney model over character n-grams of trusted text.

Symbols are UTF-16 units. Counts of trusted text, continuation counts, discounts and probabilities are Spark aggregates
and joins on the n-gram or its context. To score documents, each part of them lists its distinct n-grams once, these
are joined with the counts, level by level, and the answers return to their part: one row for each part and distinct
n-gram, however large the corpus is, and nothing of it goes through the driver. A document's perplexity is held against
a quantile of the trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, pieces, scratch
from corpusloom.llm.tokens import forget

ORDER = 4
#: Trusted ids (8 bytes each) up to so many are sent to the tasks.
BROADCAST_IDS = 2_000_000
#: Symbols of average text that a document's judged perplexity starts from, so that very short texts aren't judged by chance.
PRIOR = 40
#: Bytes of text of a part, and bytes of rows that a task packs together.
PART_BYTES, HELD = 8 << 20, 16 << 20
UNSEEN = 1e-4  # the share of probability for symbols that trusted text lacks


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each symbol, as 16 bits a symbol, and each text's number of symbols. Texts start from nothing (0)."""
    units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    gap, n = np.zeros(ORDER - 1, np.uint16), np.array([u.size for u in units])
    flat = np.concatenate([x for u in units for x in (gap, u)] or [gap]).astype(np.uint64)
    key = np.zeros(max(flat.size - ORDER + 1, 0), np.uint64)
    for k in range(ORDER):
        key |= flat[k : k + key.size] << np.uint64(16 * (ORDER - 1 - k))
    starts = np.cumsum(n + ORDER - 1) - n - (ORDER - 1)
    place = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return key[place].view(np.int64), n


def _with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the column _trusted: whether labels have quality 1 for the doc_id."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("_good")).dropna().distinct()
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    return docs.join(good, docs["doc_id"] == F.col("_good"), "left").withColumn("_trusted", F.col("_good").isNotNull()).drop("_good")


def _counts(docs: DataFrame) -> DataFrame:
    """key, n: the n-grams of all texts with their numbers, counted within a task's pieces first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in pieces(batches, "text", 1 << 20):
            keys, _ = _grams(b.column("text").to_pylist())
            code, uniques = pd.factorize(keys)
            yield pa.RecordBatch.from_arrays([pa.array(uniques), pa.array(np.bincount(code, minlength=uniques.size))], ["key", "n"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, "key long, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def _last(key: Column, order: int) -> Column:
    return key if order >= ORDER else key.bitwiseAND(F.lit((1 << (16 * order)) - 1))


@dataclass(frozen=True)
class Model:
    """What training leaves: counts (key, n) and three discounts by order, and the limits.

    limits: lang, mean, limit (logarithms of perplexities); the row with lang null is for other languages.
    """

    counts: dict[int, DataFrame]
    discounts: dict[int, tuple[float, float, float]]
    total: int
    limits: DataFrame | None = None


def train(texts: DataFrame) -> Model:
    """Counts of the n-grams of texts (column text); lower orders count the different symbols before."""
    counts = {ORDER: materialize(_counts(texts), f"grams{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        own = _last(F.col("key"), order).alias("key")
        counts[order] = materialize(counts[order + 1].groupBy(own).agg(F.count(F.lit(1)).alias("n")), f"grams{order}")
    discounts = {}
    for order in range(2, ORDER + 1):
        r = counts[order].agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
        y = r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] else 0.5
        discounts[order] = tuple(
            min(max(i - (i + 1) * y * r[f"n{i + 1}"] / r[f"n{i}"], 0.05), i - 0.05) if r[f"n{i}"] else i / 2 for i in (1, 2, 3)
        )
    return Model(counts, discounts, counts[1].agg(F.sum("n")).first()[0] or 1)


def probabilities(keys: DataFrame, model: Model) -> DataFrame:
    """key, logp for each row of keys, seen in training or not: an n-gram that it lacks backs off to shorter ones."""
    first = model.counts[1].select(F.col("key").alias("_1"), (F.col("n") / model.total * (1 - UNSEEN)).alias("p"))
    out = keys.select("key", _last(F.col("key"), 1).alias("_1")).join(first, "_1", "left")
    out = out.select("key", F.coalesce("p", F.lit(UNSEEN / 65536)).alias("p"))
    for order in range(2, ORDER + 1):
        c, d = model.counts[order], model.discounts[order]
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.shiftrightunsigned("key", 16).alias("_c")
        held = c.groupBy(context).agg(F.sum("n").alias("_total"), (F.sum(discount) / F.sum("n")).alias("_gamma"))
        seen = c.select(F.col("key").alias("_k"), (F.col("n") - discount).alias("_rest"))
        own = out.withColumn("_k", _last(F.col("key"), order)).withColumn("_c", F.shiftrightunsigned("_k", 16))
        more = F.coalesce(F.col("_rest") / F.col("_total"), F.lit(0.0)) + F.coalesce("_gamma", F.lit(1.0)) * F.col("p")
        out = own.join(held, "_c", "left").join(seen, "_k", "left").select("key", more.alias("p"))
    return out.select("key", F.log("p").alias("logp"))


def _packed(docs: DataFrame, parts: int) -> DataFrame:
    """part, rows: the rows of docs, dealt to parts by a hash of the text, in blocks of at most 1 MB of text as compressed Arrow streams.

    A task holds at most HELD bytes of rows that aren't packed yet.
    """
    named = docs.withColumn("part_", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size = {}, 0

        def blocks() -> Iterator[pa.RecordBatch]:
            for part, some in sorted(held.items()):
                whole = pa.Table.from_batches(some).combine_chunks().to_batches()
                for b in pieces(whole, "text", 1 << 20):
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as stream:
                        stream.write_batch(b)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["part", "rows"])

        for b in pieces(batches, "text", 1 << 20):
            own = b.column("part_").to_numpy()
            rows = b.drop_columns(["part_"])
            order = np.argsort(own, kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(own[order]) != 0)) if own.size else []
            for i, j in zip(edge, [*edge[1:], own.size], strict=True):
                held.setdefault(int(own[order[i]]), []).append(rows.take(pa.array(order[i:j])))
            size += rows.nbytes
            if size >= HELD:
                yield from blocks()
                held, size = {}, 0
        yield from blocks()

    return named.mapInArrow(run, "part int, rows binary")


def _opened(block: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(block.as_buffer()).read_next_batch()


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with nll_ (sum of negative log probabilities) and n_ (symbols) of the whole text.

    Documents are dealt to parts of about PART_BYTES, in packed blocks: once to list the n-grams of each part, and once
    together with their probabilities. Those come first, so a task holds one part's table and streams through its
    documents.
    """
    base = docs.withColumn("text", F.col("text").cast("string"))
    total = base.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    blocks = _packed(base, max(1, -(-total // PART_BYTES)))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = {}  # of the few parts that a task has
        for b in batches:
            for p, rows in zip(b.column("part").to_pylist(), b.column("rows"), strict=True):
                keys = np.unique(_grams(_opened(rows).column("text").to_pylist())[0])
                mine = known.get(p, np.zeros(0, np.int64))
                new = np.setdiff1d(keys, mine, assume_unique=True)
                known[p] = np.union1d(mine, new)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(new.size, p, np.int32)), pa.array(new)], ["part", "key"])

    with scratch() as keep:
        wanted = blocks.repartition("part").mapInArrow(asked, "part int, key long").distinct()
        wanted = materialize(wanted, "asked")
        logp = materialize(probabilities(wanted.select("key").distinct(), model), "logp")
        keep.append(answers := materialize(wanted.join(logp, "key").select("part", "key", "logp"), "answers"))
    both = answers.unionByName(blocks, allowMissingColumns=True)
    dealt = both.repartition("part").sortWithinPartitions("part", F.col("logp").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part, keys, values, held = None, None, None, []
        for b in batches:
            parts, new = b.column("part").to_numpy(), b.column("logp").is_valid().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.append(True, (parts[1:] != parts[:-1]) | (new[1:] != new[:-1]))) if b.num_rows else []
            for i, j in zip(edge, [*edge[1:], b.num_rows], strict=True):
                if parts[i] != part:
                    part, keys, held = parts[i], None, []
                here = b.slice(i, j - i)
                if new[i]:
                    held.append((here.column("key").to_numpy(), here.column("logp").to_numpy()))
                    continue
                if keys is None:
                    keys, values = (np.concatenate([h[k] for h in held] or [np.zeros(0)]) for k in (0, 1))
                    order = np.argsort(keys)
                    keys, values, held = keys[order], values[order], []
                for block in here.column("rows"):
                    rows = _opened(block)
                    grams, n = _grams(rows.column("text").to_pylist())
                    code, uniques = pd.factorize(grams)
                    sums = np.concatenate([[0.0], np.cumsum(-values[np.searchsorted(keys, uniques)][code])])
                    ends = np.cumsum(n)
                    cols = [*rows.columns, pa.array(sums[ends] - sums[ends - n], pa.float64()), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, [*rows.schema.names, "nll_", "n_"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return dealt.mapInArrow(run, f"{fields}, nll_ double, n_ long")


def fit(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, stretch: float = 1.0, folds: int = 5, least: int = 50) -> Model:
    """Model trained on the trusted documents of docs (quality 1), with each language's limit.

    One trusted document in ``folds`` (by hash of doc_id) isn't trained on; limits come from those: a language's limit
    is their quantile. A language with fewer than ``least`` such documents has its own mean, but the spread of all
    languages together; the row with lang null is for the others. With a ``stretch`` other than 1 limits lie that many
    times as far over the median as the quantile does. Labels that clash trust a document; null ids, texts and labels
    train nothing; without trusted text there are no limits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    trusted = _with_trust(rows, labels).where("_trusted")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(folds)) == 0
    model = train(trusted.where(~held))
    with scratch() as keep:
        scored = _scored(trusted.where(held).select("text", "lang"), model).select("lang", F.col("nll_").alias("nll"), F.col("n_").alias("n"))
        keep.append(scored := materialize(scored, "held"))
    mean = (F.sum("nll") / F.greatest(F.sum("n"), F.lit(1))).alias("mean")
    overall = scored.agg(mean).first()["mean"] or 0.0
    over = (F.col("nll") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR) - F.col("mean")
    half, limit = (F.percentile_approx("over", q, 100_000) for q in (0.5, quantile))
    limit = (half + stretch * (limit - half)).alias("limit") if stretch != 1 else limit.alias("limit")
    far = scored.join(scored.where("lang is not null").groupBy("lang").agg(mean), "lang").withColumn("over", over)
    spread = far.agg(limit).first()["limit"]
    by_lang = far.groupBy("lang").agg(F.max("mean").alias("mean"), F.when(F.count(F.lit(1)) >= least, limit).alias("limit"))
    by_lang = by_lang.select("lang", "mean", (F.col("mean") + F.coalesce("limit", F.lit(spread))).alias("limit"))
    rest = scored.sparkSession.createDataFrame(
        [(None, float(overall), None if spread is None else float(overall) + spread)], "lang string, mean double, limit double"
    )
    return Model(model.counts, model.discounts, model.total, materialize(by_lang.unionByName(rest), "limits"))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with perplexity, judged, limit and rejected, for every row; columns of these names are replaced.

    perplexity is the text's own, null for null and empty texts; judged starts from PRIOR symbols of the language's
    average text, and a row is rejected where it is over limit. So null and empty texts aren't rejected; without trusted
    text nothing is. Repeated rows are judged alike; other columns may have any name; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("perplexity", "judged", "limit", "rejected")]
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text").cast("string").alias("text"))
    lang = F.col(f"c{names.index('lang')}").cast("string")
    rest = model.limits.where("lang is null").select(F.col("mean").alias("mean_"), F.col("limit").alias("limit_"))
    own = model.limits.where("lang is not null").select(F.col("lang").alias("lang_"), "mean", "limit")
    # As many rows as there are languages with trusted text, and one.
    out = _scored(base.drop(f"c{names.index('text')}"), model)
    out = out.join(F.broadcast(own), lang == F.col("lang_"), "left").join(F.broadcast(rest))
    mean, limit = F.coalesce("mean", "mean_"), F.coalesce("limit", "limit_")
    judged = (F.col("nll_") + PRIOR * mean) / (F.col("n_") + PRIOR)
    return out.select(
        *[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)],
        F.exp(F.col("nll_") / F.when(F.col("n_") > 0, F.col("n_"))).alias("perplexity"), F.exp(judged).alias("judged"), F.exp(limit).alias("limit"),
        F.coalesce(judged > limit, F.lit(False)).alias("rejected"),
    )
