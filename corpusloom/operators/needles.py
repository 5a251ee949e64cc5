"""Which function of a repository an answer repeats: the best of all needles by BLEU, scoring only those that can win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.bleu import bleu
from corpusloom.operators.stages import stored


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\x1c-\x1f\x85\xa0]+"), lambda w: w != "")


def _pairs_of(words: Column) -> Column:
    """Neighbouring words, two by two."""
    at = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))


def _hits(candidate: Column, reference: Column) -> Column:
    """At most how many of the candidate's n-grams the reference has: each distinct one it lacks misses at least once."""
    found = F.size(candidate) - F.size(F.array_distinct(candidate)) + F.size(F.array_intersect(candidate, reference))
    return F.least(found, F.size(reference)).cast("double")


def bleu_bound(c: Column, r: Column, c2: Column, r2: Column) -> Column:
    """No less than BLEU-4 of two arrays of words, from their lengths and the distinct words and pairs of words they share.

    Runs of three and four words hit no more often than pairs do, a precision without hits counts as at most a tenth of
    the logarithm of the length, and a candidate no longer than the reference pays for its brevity, all as in BLEU. A
    candidate of one word, or without a common word, has 0.
    """
    n = F.size(c).cast("double")
    longer = F.greatest(F.when(F.size(F.array_intersect(c2, r2)) > 0, _hits(c2, r2)).otherwise(0.0), F.log(n) / 10)
    product = F.least(F.lit(1.0), _hits(c, r) / n)
    for k in (2, 3, 4):
        product = product * F.least(F.lit(1.0), longer / F.greatest(n - (k - 1), F.lit(1.0)))
    brevity = F.when(n > F.size(r), F.lit(1.0)).otherwise(F.exp(1 - F.size(r) / n))
    return F.when((n > 1) & (F.size(F.array_intersect(c, r)) > 0), brevity * F.pow(product, F.lit(0.25)) * (1 + 1e-9)).otherwise(0.0)


def possible_pairs(answers: DataFrame, needles: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of answers (by, item_id, text) with needles (by, place, name, text) of their corpus that may be the best.

    Of each answer the pair of the highest bound is scored first; what has a bound under that score can't win. Adds
    first (that score) and bound.
    """
    split = lambda df, x: df.withColumn(x, _words(F.col("text"))).withColumn(f"{x}2", _pairs_of(F.col(x)))
    a = split(answers, "_a").select(*by, "item_id", F.col("text").alias("answer"), "_a", "_a2")
    n = split(needles, "_n").select(*by, "place", "name", F.col("text").alias("needle"), "_n", "_n2")
    bound = bleu_bound(*map(F.col, ("_a", "_n", "_a2", "_n2")))
    keys = a.join(n, by).withColumn("bound", bound).where("bound > 0").select(*by, "item_id", "place", "name", "answer", "needle", "bound")
    pairs = stored(keys)  # read twice, and bounds are the most of the work
    top = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("bound").desc(), F.col("place").asc()))
    best = pairs.withColumn("_n", top).where("_n = 1").select("item_id", bleu("answer", "needle").alias("first"))
    return pairs.join(best, "item_id").where("bound >= first")


def best_needles(answers: DataFrame, needles: DataFrame, by: list[str], threshold: float = 0.8) -> DataFrame:
    """item_id, best_target, best_similarity, pass_at_1 for answers (by, item_id, text, truth: a needle's name).

    The needle of the answer's corpus with the highest BLEU, the first by ``place`` of equal ones; null and 0 where none
    shares a word. Passed is who names the truth with at least ``threshold``. Blank answers and answers of corpora
    without needles have no target. Only pairs that can be the best are scored.
    """
    scored = possible_pairs(answers, needles, by).withColumn("similarity", bleu("answer", "needle")).where("similarity > 0")
    best = scored.groupBy("item_id").agg(F.max_by(F.struct("name", "similarity"), F.struct("similarity", -F.col("place"))).alias("b"))
    both = answers.select("item_id", "truth").join(best, "item_id", "left")
    similarity = F.coalesce("b.similarity", F.lit(0.0))
    passed = F.coalesce((F.col("b.name") == F.col("truth")) & (similarity >= threshold), F.lit(False))
    return both.select("item_id", F.col("b.name").alias("best_target"), F.round(similarity, 6).alias("best_similarity"), passed.cast("double").alias("pass_at_1"))
