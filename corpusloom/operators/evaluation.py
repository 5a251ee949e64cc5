"""Retrieval quality: confusion counts, rates, ranks, samples and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import ratio
from corpusloom.operators.ranges import totals_from


def confusion(labelled: DataFrame, *by: str) -> DataFrame:
    """Counts of gold (0 or 1) against predicted (0 or 1), by group."""
    g, p = F.col("gold") == 1, F.col("predicted") == 1
    return labelled.groupBy(*by).agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")
    )


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and accuracy; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns(
        {
            "precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6),
            "accuracy": F.round(ratio(tp + tn, tp + fp + fn + tn), 6),
        }
    )


def micro(counts: DataFrame) -> DataFrame:
    """Rates of the summed counts, not means of rates."""
    return rates(counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))


def example_relevance(gold: DataFrame, retrieved: DataFrame, examples: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts and rates of each example: which of its chunks (gold: by, doc_id, gold 0 or 1) were retrieved (by, doc_id).

    Only corpora that an example (by) has count; without a retrieved chunk all are left out. Repeated rows count once.
    """
    got = retrieved.select(*by, "doc_id").distinct().withColumn("predicted", F.lit(1))
    every = gold.join(examples.select(*by).distinct(), by, "left_semi").dropDuplicates([*by, "doc_id"])
    judged = every.join(got, [*by, "doc_id"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    return rates(confusion(judged, *by))


def reciprocal_ranks(ranked: DataFrame, hit: Column) -> DataFrame:
    """mrr_recovered: mean reciprocal rank of questions with a hit; mrr: over all questions; recovered and questions."""
    first = ranked.groupBy("item_id").agg(F.min(F.when(hit, F.col("rank"))).alias("r"))
    rr = F.when(F.col("r").isNotNull(), 1.0 / F.col("r"))
    return first.agg(
        F.round(F.coalesce(F.avg(rr), F.lit(0.0)), 6).alias("mrr_recovered"),
        F.round(F.coalesce(F.avg(F.coalesce(rr, F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"),
        F.count("r").alias("recovered"), F.count(F.lit(1)).alias("questions"),
    )


def balanced_sample(rows: DataFrame, group: str, key: str, count: int, seed: str) -> DataFrame:
    """count rows spread evenly over all groups there are, chosen and ordered by sha256 of seed and key, dealt round-robin.

    The first count % groups groups in the order of their seeded hash get one more. Of each group only as many rows as
    any may give are ranked.
    """
    h = lambda c: F.sha2(F.concat_ws("|", F.lit(seed), c.cast("string")), 256)
    order = rows.select(group).distinct().withColumn("_place", F.row_number().over(Window.orderBy(h(F.col(group)), group)))  # one row a group
    groups = order.count()
    quota = order.withColumn("_quota", F.lit(count // max(groups, 1)) + F.when(F.col("_place") <= count % max(groups, 1), 1).otherwise(0))
    w = Window.partitionBy(group).orderBy(h(F.col(key)), key)
    most = -(-count // max(groups, 1))
    first = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)  # literal bound: rows beyond go before the sort
    taken = first.withColumn("n", F.col("n").cast("long")).join(F.broadcast(quota), group).where("n <= _quota")
    return taken.withColumn("position", F.row_number().over(Window.orderBy("n", "_place")).cast("long")).drop("_quota", "_place")


def sweep(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rates of every threshold (threshold) over scored rows (gold, score); a row is predicted at or over the threshold.

    Scores are sorted once, whatever the number of thresholds. Rows without gold or score count for nothing.
    """
    rows = scored.where("gold is not null and score is not null").select(F.col("score").cast("double").alias("threshold"), F.lit(1).alias("n"), (F.col("gold") == 1).cast("int").alias("tp"))
    told = totals_from(rows, thresholds.select(F.col("threshold").cast("double").alias("threshold")), "threshold", ["n", "tp"])
    whole = rows.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("tp"), F.lit(0)).alias("_p"))
    both = told.join(F.broadcast(whole))  # one row
    return rates(both.select("threshold", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("_p") - F.col("n") + F.col("tp")).alias("tn")))


def span_labels(blocks: DataFrame) -> DataFrame:
    """blocks (lo, hi, text, spans) with label: 1 if the block's lines contain a span whose trimmed text is empty or in the block."""
    inside = F.exists("spans", lambda s: (F.col("lo") <= s["lo"]) & (F.col("hi") >= s["hi"]) & ((F.trim(s["text"]) == "") | F.col("text").contains(F.trim(s["text"]))))
    return blocks.withColumn("label", inside.cast("int"))
