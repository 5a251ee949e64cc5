"""Records around chunks and runs: vector payloads, metadata, completeness, runs as JSON files and what of them can be resumed."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.sourcecode import Options


@dataclass(frozen=True)
class Profile:
    """How chunks are sized for an embedding model: limits in tokens, which are bytes here."""

    version: str = "v1"
    input_tokens: int = 8192
    margin: float = 0.1
    target: int = 1024
    overlap: float = 0.2

    @property
    def budget(self) -> int:
        """Bytes of a chunk with its context."""
        return int(self.input_tokens * (1 - self.margin))

    @property
    def options(self) -> Options:
        """Chunks of the target size, but at most seven tenths of the budget, and at least 128 bytes."""
        return Options(most=max(128, min(self.target, int(self.budget * 0.7))), overlap=self.overlap)

    @property
    def key(self) -> str:
        """The version and what the settings hash to, so that other settings have another key."""
        settings = json.dumps(asdict(self) | asdict(self.options), separators=(",", ":"), sort_keys=True)
        return f"{self.version}:{hashlib.sha256(settings.encode()).hexdigest()[:16]}"


def syntax_kind(node_type: Column) -> Column:
    """What kind of entity a syntax node is, by its type's name; null for none. The first rule that fits holds."""
    t = F.lower(node_type)
    plain = ~t.contains("declarator") & ~t.contains("expression") & ~t.contains("call")
    return (
        F.when(t.contains("import") | t.isin("using_directive", "require"), "import").when(t.contains("export"), "export")
        .when(t.contains("interface") | (t == "protocol_declaration"), "interface")
        .when(t.contains("class") | t.contains("struct") | t.contains("module"), "class").when(t.contains("enum"), "enum")
        .when(t.contains("type") & t.contains("declaration"), "type").when(t.contains("method") | (t == "constructor_declaration"), "method")
        .when(t.contains("function") & plain, "function")
    )


def tagged_kind(capture: Column) -> Column:
    """What kind a tag query's capture, such as definition.method, defines; null for none."""
    k = F.lower(F.substring_index(capture, "definition.", -1))
    has = lambda *words: k.rlike("|".join(words))
    return (
        F.when(has("method"), "method").when(has("function", "macro"), "function").when(has("class", "module", "namespace"), "class")
        .when(has("interface", "trait"), "interface").when(has("enum"), "enum").when(has("type", "constant"), "type")
    )


def chunk_entities(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, chunk_index, name, kind, partial: the entities that begin in a chunk, partial where they end behind it.

    chunks: doc_id, chunk_index, byte_start, byte_end, without gaps; entities: doc_id, number, name, kind, byte_start,
    byte_end. One sorted pass a file: an entity is in the chunk with the last start before its own, so nothing is
    joined by range.
    """
    c = chunks.select("doc_id", F.col("byte_start").alias("at"), F.lit(0).alias("is_entity"), "chunk_index", F.col("byte_end").alias("chunk_end"), *(F.lit(None).cast(t).alias(n) for n, t in (("number", "long"), ("name", "string"), ("kind", "string"), ("end", "long"))))
    e = entities.select("doc_id", F.col("byte_start").alias("at"), F.lit(1).alias("is_entity"), F.lit(None).cast("long").alias("chunk_index"), F.lit(None).cast("long").alias("chunk_end"), "number", "name", "kind", F.col("byte_end").alias("end"))
    w = Window.partitionBy("doc_id").orderBy("at", "is_entity", "number").rowsBetween(Window.unboundedPreceding, 0)
    both = c.unionByName(e).withColumns({"chunk_index": F.last("chunk_index", True).over(w), "chunk_end": F.last("chunk_end", True).over(w)})
    return both.where("is_entity = 1").select("doc_id", "chunk_index", "number", "name", "kind", (F.col("end") > F.col("chunk_end")).alias("partial"))


def completeness(checks: dict[str, Column]) -> Column:
    """share: how many of the named conditions hold, of all, to two digits; missing: the names of the others, in order."""
    held = [F.coalesce(c, F.lit(False)) for c in checks.values()]
    share = sum((c.cast("int") for c in held[1:]), held[0].cast("int")) / F.lit(float(len(held)))
    missing = F.filter(F.array(*(F.when(~c, n) for n, c in zip(checks, held, strict=True))), lambda x: x.isNotNull())
    return F.struct(F.round(share, 2).alias("share"), missing.alias("missing"))


def searchable(path: Column, language: Column, context: Column) -> Column:
    """The text that keyword search reads beside a chunk's own: its path, language and context as JSON."""
    return F.to_json(F.struct(path.alias("path"), language.alias("language"), context.alias("context")))


def mock_embedding(text: Column, dimension: int) -> Column:
    """A vector that needs no model: the text's length, 0 and 1, cut to the dimension or filled up with zeros."""
    base = F.concat(F.array(F.length(F.coalesce(text, F.lit(""))).cast("double"), F.lit(0.0), F.lit(1.0)), F.array_repeat(F.lit(0.0), max(dimension - 3, 0)))
    return F.slice(base, 1, dimension)


def vector_records(inputs: DataFrame, model: str, dimension: int) -> DataFrame:
    """id, content_hash, payload (a struct) of chunks that are to be embedded: id, text (with context) and any other columns.

    The payload has all columns but the id, and the content's hash, the model and its dimension.
    """
    own = ["content_hash", "model_id", "dimension"]
    told = [F.col(c) for c in inputs.columns if c not in ("id", *own)]
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return inputs.select("id", digest.alias("content_hash"), F.struct(*told, digest.alias("content_hash"), F.lit(model).alias("model_id"), F.lit(dimension).alias("dimension")).alias("payload"))


def merged_payloads(first: DataFrame, later: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key; where both have a column, the later one's value counts unless it is null."""
    cols = [c for c in dict.fromkeys([*first.columns, *later.columns]) if c not in key]
    a, b = first.alias("a"), later.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full")
    pick = lambda c: F.coalesce(*(F.col(f"{s}.{c}") for s, df in (("b", later), ("a", first)) if c in df.columns))
    return both.select(*(pick(c).alias(c) for c in [*key, *cols]))


def askable(questions: DataFrame, most: int = 4000) -> DataFrame:
    """Questions whose text isn't blank and has at most ``most`` characters."""
    return questions.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.length("text") <= most))


def reference_spans(spans: Column) -> Column:
    """The trimmed spans that aren't empty, or one N/A."""
    kept = F.filter(F.transform(spans, lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0, kept).otherwise(F.array(F.lit("N/A")))


def retrieval_contexts(ranked: DataFrame, budget: int = 13_000) -> DataFrame:
    """item_id, pieces, context: the ranked chunks (item_id, number, path, start_line, end_line, text) as one text a question.

    Each has its path and lines above it; what exceeds ``budget`` characters is cut off, empty lines between don't count.
    """
    head = F.concat(F.lit("// Path: "), F.coalesce("path", F.lit("unknown")), F.lit(" (lines "), F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("?")), F.lit(")\n"))
    rows = ranked.select("item_id", "number", F.concat(head, F.coalesce("text", F.lit(""))).alias("piece"))
    w = Window.partitionBy("item_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    left = budget - F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0))
    cut = rows.withColumn("left", left).where("left > 0").withColumn("piece", F.left("piece", F.col("left").cast("int")))
    ordered = F.array_sort(F.collect_list(F.struct("number", "piece")))  # at most the chunks of one question's budget
    return cut.groupBy("item_id").agg(F.count(F.lit(1)).alias("pieces"), F.array_join(F.transform(ordered, lambda p: p["piece"]), "\n\n").alias("context"))


def needles_of(raw: DataFrame) -> DataFrame:
    """language, repo, commit_sha, path, name, start_line, end_line, description, function, one row a function to find.

    raw: language, repository (repo, commit_sha, content: map of path to text, needles). The function is its file's
    lines from start_line (not counted in, as lines count from 0) to end_line.
    """
    each = raw.select("language", "repository", F.explode("repository.needles").alias("n"))
    lines = F.split(F.element_at("repository.content", F.col("n.path")), "\r\n|\r|\n")
    function = F.array_join(F.slice(lines, F.col("n.start_line").cast("int") + 1, F.greatest(F.col("n.end_line") - F.col("n.start_line"), F.lit(0)).cast("int")), "\n")
    return each.select("language", "repository.repo", "repository.commit_sha", "n.path", "n.name", "n.start_line", "n.end_line", "n.description", function.alias("function"))


RUN = (
    "id string, created_at string, status string, error string, retry_of string, completed_examples long, total_examples long,"
    " request struct<benchmark string, model string, limit long, seed string>,"
    " result struct<retrieval map<string, string>, dataset struct<sample_fingerprint string>,"
    " examples array<struct<index long, candidate_answer string, raw_response string, response_status string, scores map<string, double>>>>"
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """RUN of the JSON files of evaluation runs under path, one a run; answers of older runs are filled in.

    An answer without its raw response is its own, and the other way round; where both are empty and no status is
    given, it is empty_legacy_response.
    """
    runs = spark.read.schema(RUN).json(path, multiLine=True)

    def mended(e: Column) -> Column:
        empty = (e["candidate_answer"] == "") & (e["raw_response"] == "")
        return F.struct(
            e["index"].alias("index"), F.coalesce(e["candidate_answer"], e["raw_response"]).alias("candidate_answer"), F.coalesce(e["raw_response"], e["candidate_answer"]).alias("raw_response"),
            F.coalesce(e["response_status"], F.when(empty, "empty_legacy_response")).alias("response_status"), e["scores"].alias("scores"),
        )

    return runs.withColumn("result", F.when(F.col("result").isNotNull(), F.col("result").withField("examples", F.transform("result.examples", mended))))


def retry_problem(configuration: dict[str, str]) -> Column:
    """Why a run (RUN) can't be resumed under this configuration of retrieval, or null."""
    r = F.col("result")
    changed = F.lit(False)
    for k, v in configuration.items():
        changed = changed | ~F.element_at(r["retrieval"], F.lit(k)).eqNullSafe(F.lit(v))
    scored = F.size(F.filter(F.coalesce(r["examples"], F.array()), lambda e: e["scores"].isNotNull()))
    return (
        F.when(~F.coalesce(F.col("status").isin("failed", "completed_with_errors", "cancelled"), F.lit(False)), "not finished with missing examples")
        .when(r.isNull() | F.col("request.seed").isNull(), "no saved sample")
        .when(F.coalesce(r["dataset"]["sample_fingerprint"], F.lit("")) == "", "no sample fingerprint")
        .when(F.coalesce(F.size(r["retrieval"]), F.lit(0)) <= 0, "older than retrieval")
        .when(changed, "retrieval settings changed")
        .when(scored >= F.col("request.limit"), "no failed examples")
    )


def cancelled(runs: DataFrame) -> DataFrame:
    """Runs with those queued or running as cancelled, without an error."""
    open_ = F.col("status").isin("queued", "running")
    return runs.withColumns({"status": F.when(open_, "cancelled").otherwise(F.col("status")), "error": F.when(~open_, F.col("error"))})


def unanswered(sample: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of sample (run_id, index, anything) that the run has no scores of: what a resumed run still has to do."""
    done = runs.select(F.col("id").alias("run_id"), F.explode("result.examples").alias("e")).where("e.scores is not null").select("run_id", F.col("e.index").alias("index"))
    return sample.join(done, ["run_id", "index"], "left_anti")
