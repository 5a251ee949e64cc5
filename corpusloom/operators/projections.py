"""Column functions of reports, prompts and identities, and small reconciliations of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranges import running_sums, totals_from
from corpusloom.operators.sourcecode import line_suffix

SPACE = "[ \\t\\n\\x0b\\f\\r]+"


def signature(text: Column, most: int = 240) -> Column:
    """The text on one line, cut."""
    return F.left(F.trim(F.regexp_replace(text, SPACE, " ")), F.lit(most))


def grade_of(score: Column, c: int, b: int, a: int) -> Column:
    """D under c, C under b, B under a, else A; A too for what has no score."""
    return F.when(score < c, "D").when(score < b, "C").when(score < a, "B").otherwise("A")


def citation_defaults(kind: Column, line: Column) -> tuple[Column, Column]:
    """A citation's kind, unknown where it is null or empty, and its line, 1 where it is null."""
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")), F.coalesce(line, F.lit(1))


def file_fingerprint(path: Column, sha256: Column, size: Column, language: Column, options: Column, version: int) -> Column:
    """SHA-256 of a file's facts and chunking options (a struct) as JSON with sorted keys: the same for the same chunks."""
    facts = {"language": language, "options": options, "path": path, "sha256": sha256, "size": size, "version": F.lit(version)}
    return F.sha2(F.to_json(F.struct(*(c.alias(k) for k, c in facts.items()))), 256)


def chunk_metadata(path: Column, language: Column, context: Column) -> Column:
    """What keyword search reads of a chunk beside its text, as JSON with sorted keys, nulls included."""
    return F.to_json(F.struct(context.alias("context"), language.alias("language"), path.alias("path")), {"ignoreNullFields": "false"})


def identifier(name: Column) -> Column:
    """A name for files and options: ++ is pp, # is sharp, runs of other signs one hyphen."""
    spelled = F.replace(F.replace(F.lower(name), F.lit("++"), F.lit("pp")), F.lit("#"), F.lit("sharp"))
    return F.regexp_replace(F.regexp_replace(spelled, "[^a-z0-9]+", "-"), "^-|-$", "")


def collection(model: Column, dimension: Column) -> Column:
    """A collection's name: the model as identifier, cut, its dimension, and 8 digits of its hash."""
    return F.concat_ws("_", F.left(identifier(model), F.lit(32)), dimension.cast("string"), F.left(F.sha2(model, 256), F.lit(8)))


def fenced(text: Column) -> Column:
    """What stands in the first fenced block, or the whole text; without white space at both ends."""
    inside = F.regexp_extract(text, r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```", 1)
    return F.btrim(F.when(text.rlike(r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```"), inside).otherwise(text), F.lit(" \t\r\n"))


def quality(engine: Column, completeness: Column, recovered: Column, fallback: Column) -> tuple[Column, Column]:
    """Grade and score of a chunk: a band by engine, more of it the more metadata there is, less after recovery and fallback."""
    low = F.when(engine == "native", 90).when(engine == "tree", 75).when(engine == "logical", 55).otherwise(35)
    width = F.when(engine == "native", 10).when(engine == "tree", 14).otherwise(19)
    score = low + F.floor(width * completeness + 0.5) - F.when(recovered, 5).otherwise(0) - F.when(fallback, 3).otherwise(0)
    grade = F.when(engine == "native", "A").when(engine == "tree", "B").when(engine == "logical", "C").otherwise("D")
    return grade, F.greatest(low, score).cast("long")


def metric_text(value: Column) -> Column:
    """A share as percent with one digit, another number with three."""
    return F.when((value >= 0) & (value <= 1), F.format_string("%.1f%%", value * 100)).otherwise(F.format_string("%.3f", value))


def metric_label(name: Column) -> Column:
    return F.initcap(F.replace(F.regexp_replace(name, "^average_", ""), F.lit("_"), F.lit(" ")))


def display_status(failed: Column, message: Column, busy: Column, ready: Column) -> Column:
    """What a list shows: the failure's own words before all, then work under way, then whether answers can be given."""
    return F.when(failed, F.coalesce(F.nullif(message, F.lit("")), F.lit("Failed"))).when(busy, "Processing").when(ready, "Ready").otherwise("Not Ready")


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def line_overlap(docs: DataFrame, target: int) -> DataFrame:
    """doc_id, from_byte, overlap_bytes: the whole last lines whose bytes are closest to target, more of them in a tie.

    Lines are measured in their row; texts without bytes have none.
    """
    size = F.octet_length(line_suffix(F.col("text"), F.lit(target))).cast("long")
    told = docs.where(F.octet_length("text") > 0).select("doc_id", F.octet_length("text").cast("long").alias("total"), size.alias("overlap_bytes"))
    return told.select("doc_id", (F.col("total") - F.col("overlap_bytes")).alias("from_byte"), "overlap_bytes")


def quantile_grid(scores: DataFrame, column: str, steps: int = 500) -> DataFrame:
    """threshold: 0 and at most ``steps`` + 1 of the distinct scores, evenly by their places in order, rounded to even."""
    distinct = scores.select(F.col(column).cast("double").alias("threshold")).distinct().withColumn("place", F.lit(1))
    ranked = running_sums(distinct, [F.col("threshold").asc()], ["place"]).withColumn("place", F.col("place") - 1)
    n = ranked.count()
    k = min(steps, max(n - 1, 1))
    wanted = scores.sparkSession.range(k + 1).select(F.bround(F.col("id") * (n - 1) / F.lit(float(k))).cast("long").alias("place")).distinct()
    return ranked.join(F.broadcast(wanted), "place").select("threshold").unionByName(scores.sparkSession.createDataFrame([(0.0,)], "threshold double")).distinct()


def sweep_statistics(scored: DataFrame, thresholds: DataFrame, relatives: float | list[float], by: Sequence[str] = ()) -> DataFrame:
    """by, relative, threshold, empty_rate, negative_abstention, mean_chunks, tp, fp, fn for examples with scored (by, example, gold, score) rows.

    A row is taken at or over the threshold and the example's best times ``relative``; an example without a taken row is
    empty, and negative if no row of it is gold. Scores are sorted once a relative limit (few) and group of ``by``, and
    all thresholds read from running sums, so rows don't grow with thresholds times scores.
    """
    by, relatives = [*by, "relative"], relatives if isinstance(relatives, list) else [relatives]
    each = scored.withColumn("relative", F.explode(F.array(*map(F.lit, map(float, relatives)))))
    best = F.max("score").over(Window.partitionBy(*by, "example"))
    kept = each.withColumn("_floor", best * F.col("relative")).withColumn("threshold", F.when(F.col("score") >= F.col("_floor"), F.col("score").cast("double")))
    gold = (F.col("gold") == 1).cast("int")
    examples = kept.groupBy(*by, "example").agg(F.max("threshold").alias("threshold"), (F.max("gold") == 0).cast("int").alias("negative"), F.sum(gold).alias("positives"))
    zero = F.lit(0)
    rows = kept.select(*by, "threshold", F.lit(1).alias("n"), gold.alias("tp"), zero.alias("filled"), zero.alias("spoilt"))
    rows = rows.unionByName(examples.select(*by, "threshold", zero.alias("n"), zero.alias("tp"), F.lit(1).alias("filled"), F.col("negative").alias("spoilt")))
    whole = examples.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.sum("negative").alias("_negative"), F.sum("positives").alias("_gold"))  # one row a group
    asked = whole.select(*by).join(F.broadcast(thresholds.select(F.col("threshold").cast("double").alias("threshold"))), how="cross")  # groups times thresholds: the result's rows
    told = totals_from(rows, asked, "threshold", ["n", "tp", "filled", "spoilt"], by).join(whole, by)
    share = lambda part, all_: F.round(F.when(F.col(all_) > 0, (F.col(all_) - F.col(part)) / F.col(all_)).otherwise(0.0), 6)
    return told.select(
        *by, "threshold", share("filled", "_all").alias("empty_rate"), share("spoilt", "_negative").alias("negative_abstention"),
        F.round(F.col("n") / F.col("_all"), 6).alias("mean_chunks"), "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("_gold") - F.col("tp")).alias("fn"),
    )


def first_of_channels(*channels: DataFrame, key: list[str]) -> DataFrame:
    """The union of channels, of rows with one key that of the earliest channel."""
    out = None
    for i, c in enumerate(channels):
        c = c.withColumn("channel", F.lit(i))
        out = c if out is None else out.unionByName(c)
    w = Window.partitionBy(*key).orderBy("channel")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prompts(questions: DataFrame, pieces: DataFrame, rules: str, nothing: str) -> DataFrame:
    """item_id, sources, prompt: the rules, the question's numbered pieces (item_id, number, piece) in order, and the question.

    Without pieces the prompt says so in place of them.
    """
    ordered = F.array_sort(F.collect_list(F.struct("number", "piece")))
    joined = pieces.groupBy("item_id").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("context"), F.count(F.lit(1)).alias("sources"))
    both = questions.join(joined, "item_id", "left")
    body = F.concat(F.lit(rules), F.coalesce("context", F.lit(nothing)), F.lit("\nQuestion: "), "text")
    return both.select("item_id", F.coalesce("sources", F.lit(0)).alias("sources"), body.alias("prompt"))
