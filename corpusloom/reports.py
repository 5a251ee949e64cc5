"""Registered queries of filters, projections, joins, reports, prompts and identities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import queries as base
from corpusloom.functions import text as T
from corpusloom.operators import chunking as C
from corpusloom.operators import evaluation as E
from corpusloom.operators import lineage as N
from corpusloom.operators import projections as P
from corpusloom.operators import relational as R
from corpusloom.operators import retrieval as Q
from corpusloom.queries import query, read
from corpusloom.sources import snapshots as S

# Files and filters.


@query("""SELECT page_id, path, path = '' OR starts_with(path, '/') OR contains(path, '\\') OR regexp_matches(path, '(^|/)\\.\\.(/|$)') AS unsafe
FROM (SELECT page_id, regexp_extract(url, '://[^/]*/(.*)$', 1) AS path FROM pages)""".replace("'\\\\'", "chr(92)").replace("'\\'", "chr(92)"))
def p02_unsafe_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "://[^/]*/(.*)$", 1)
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"), S.unsafe_path(path).alias("unsafe"))


@query("""SELECT CASE WHEN strlen(text) > 8000 THEN 'too_large' WHEN strlen(text) >= 2000 THEN 'large' ELSE 'ordinary' END AS route, count(*) AS files, sum(strlen(text))::BIGINT AS bytes
FROM documents GROUP BY 1""")
def p10_file_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.octet_length("text").cast("long").alias("size"))
    return d.groupBy(S.route(F.col("size"), 2000, 8000).alias("route")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(f"WITH {base._JOBS_SQL} SELECT id, attempt_count FROM jobs WHERE status = 'queued' AND (lease_expires_at IS NULL OR lease_expires_at <= 50)")
def p15_due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.due(base._jobs(spark, sf_dir), F.lit(50)).select("id", "attempt_count")


@query(f"WITH {base._JOBS_SQL} SELECT id, 'queued' AS status, 0::BIGINT AS attempt_count, NULL::BIGINT AS lease_expires_at FROM jobs WHERE status = 'failed'")
def x04_requeue_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.requeued_failed(base._jobs(spark, sf_dir)).select("id", "status", "attempt_count", "lease_expires_at")


@query("""SELECT conv_id, turn, back FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations
WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE back <= 3""")
def p29_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return R.latest(turns, ["conv_id"], F.desc("turn"), n=3).select("conv_id", "turn", F.col("rn").alias("back"))


# Joins and reconciliations.


@query("""SELECT l_orderkey, l_linenumber, c_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND c_nationkey = 7""")
def j01_scoped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read(spark, sf_dir, "customer").where("c_nationkey = 7").select("c_custkey")
    files = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    seen = N.scoped(read(spark, sf_dir, "lineitem"), files, members, ("l_orderkey", "o_orderkey"), ("o_custkey", "c_custkey"))
    return seen.select("l_orderkey", "l_linenumber", "c_custkey")


@query("""SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('EUROPE', 'ASIA') AND o_orderstatus <> 'F'""")
def j05_job_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, regions = read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), read(spark, sf_dir, "region").where("r_name in ('EUROPE', 'ASIA')")
    customers, nations = (read(spark, sf_dir, t) for t in ("customer", "nation"))
    all_ = N.chained(jobs, (customers, "o_custkey", "c_custkey"), (nations, "c_nationkey", "n_nationkey"), (regions, "n_regionkey", "r_regionkey"))
    return all_.select("o_orderkey", "n_name", "r_name")


@query("""SELECT user_id AS id, CASE WHEN e.event IS NULL THEN 'missing' ELSE e.event END AS outcome FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS event FROM events WHERE event_type <> 'click' GROUP BY user_id) e USING (user_id)""")
def j08_last_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumnRenamed("user_id", "id")
    return N.last_outcomes(e, e.where("event_type <> 'click'"), "id", "event_id", "event_type")


@query("""SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')""")
def j19_access_to_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, customers, nations = (read(spark, sf_dir, t) for t in ("region", "customer", "nation"))
    good = N.chained(customers, (nations, "c_nationkey", "n_nationkey"), (regions.where("r_name = 'EUROPE'"), "n_regionkey", "r_regionkey"), how="left_semi")
    return N.to_remove(read(spark, sf_dir, "orders"), good.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")


@query("""SELECT p.user_id, p.event_id AS id, (SELECT arg_min(event_id, (ts, event_id)) FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts >= p.ts) AS event
FROM events p WHERE event_type <> 'click'""")
def j20_nearest_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    points = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("id"), F.col("us").alias("at"))
    return R.nearest_after(points, e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("event"), F.col("us").alias("time")), "user_id")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN
(SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')))""")
def k11_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are left when a region goes with all that hangs on it."""
    gone = read(spark, sf_dir, "region").where("r_name = 'ASIA'").select("r_regionkey")
    levels = [("nation", "n_regionkey", "n_nationkey"), ("customer", "c_nationkey", "c_custkey"), ("orders", "o_custkey", "o_orderkey")]
    return N.cascade(gone, *((read(spark, sf_dir, t), parent, own) for t, parent, own in levels))[-1].select("o_orderkey")


@query("SELECT DISTINCT sha256(text) AS job_key, 'queued' AS status FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s JOIN labels USING (doc_id) WHERE s.text = d.text)")
def k09_ensure_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New jobs for contents that have none."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("job_key"))
    return N.ensured(d, d.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), "job_key")


@query("""WITH a AS (SELECT source, sha256(text) AS h FROM documents WHERE source = 'src0'), b AS (SELECT 'src0' AS source, sha256(text) AS h FROM documents WHERE source = 'src1')
SELECT 'entries' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'manifest', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def u08_manifest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("source", F.lit("src0").alias("path"), F.lit(0).cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    got = S.differences(d.where("source = 'src0'"), d.where("source = 'src1'"))
    return got.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {base.FUSED_CTE}, u AS (SELECT *, 0 AS channel FROM ds_top UNION ALL SELECT *, 1 FROM kw_top)
SELECT item_id, doc_id, score, channel FROM u QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY channel) = 1""")
def u02_union_of_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = P.first_of_channels(base._dense(spark, sf_dir), base._keyword(spark, sf_dir), key=["item_id", "doc_id"])
    return both.select("item_id", "doc_id", "score", "channel")


# Reports.


@query("SELECT lang, round(coalesce(avg(quality), 0.0), 6) AS pass_rate, count(quality) AS scored FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def a08_mean_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.mean_pass(read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left"), "quality", "lang")


@query("""SELECT date_trunc('hour', ts)::VARCHAR AS hour, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'click') AS scored FROM events GROUP BY 1""")
def a10_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")
    return N.run_summary(read(spark, sf_dir, "events").withColumn("hour", hour), F.col("event_type") == "error", F.col("event_type") == "click", "hour")


@query("SELECT source, string_agg(lang || ':' || s, ',' ORDER BY lang) AS timings FROM (SELECT source, lang, sum(n_chars)::BIGINT AS s FROM documents GROUP BY ALL) GROUP BY source")
def a13_sums_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = N.sums_by_key(read(spark, sf_dir, "documents"), "source", "lang", "n_chars")
    text = F.transform(F.map_entries("sums"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return sums.select("source", F.array_join(text, ",").alias("timings"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def a16_group_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.group_counters(read(spark, sf_dir, "conversations"), "role", "conv_id").withColumnRenamed("members", "conversations")


_EXAMPLES_SQL = "x AS (SELECT source AS example, toxic AS gold, (n_chars % 1000) / 1000.0 AS score FROM documents JOIN labels USING (doc_id))"


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return both.select(F.col("source").alias("example"), F.col("toxic").alias("gold"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"))


@query(f"""WITH {_EXAMPLES_SQL}, f AS (SELECT *, max(score) OVER (PARTITION BY example) * 0.855 AS floor FROM x), t AS (SELECT (i / 5.0)::DOUBLE AS threshold FROM range(6) r(i)),
e AS (SELECT threshold, example, count(*) FILTER (score >= greatest(threshold, floor)) AS n, count(*) FILTER (score >= greatest(threshold, floor) AND gold = 1) AS tp, max(gold) AS positive FROM f, t GROUP BY ALL)
SELECT threshold, round(avg((n = 0)::INT), 6) AS empty_rate, round(coalesce(avg((n = 0)::INT) FILTER (positive = 0), 0.0), 6) AS negative_abstention, round(avg(n), 6) AS mean_chunks,
 sum(tp)::BIGINT AS tp, (sum(n) - sum(tp))::BIGINT AS fp FROM e GROUP BY threshold""")
def a17_sweep_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sweep_statistics(_examples(spark, sf_dir), spark.range(6).select((F.col("id") / 5.0).alias("threshold")), 0.855).drop("relative", "fn")


@query(f"""WITH {_EXAMPLES_SQL}, d AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT score::DOUBLE AS score FROM x)),
k AS (SELECT DISTINCT round_even(i * (n - 1) / least(500, greatest(n - 1, 1))::DOUBLE, 0)::BIGINT AS place FROM (SELECT max(n) AS n FROM d), range(501) r(i) WHERE i <= least(500, greatest(n - 1, 1)))
SELECT score AS threshold FROM d JOIN k USING (place) UNION SELECT 0.0""")
def a19_quantile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.quantile_grid(_examples(spark, sf_dir), "score")


@query("SELECT user_id, coalesce(max(value) FILTER (event_type = 'error'), 0.0) AS retry_after FROM events GROUP BY user_id")
def a22_retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.retry_after(read(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error", F.col("value"))


@query("""SELECT event_id, grade, greatest(low, low + floor(width * c + 0.5) - CASE WHEN event_type = 'error' THEN 5 ELSE 0 END - CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END)::BIGINT AS score FROM (
SELECT event_id, event_type, k, (k % 11) / 10.0 AS c, CASE e WHEN 'native' THEN 'A' WHEN 'tree' THEN 'B' WHEN 'logical' THEN 'C' ELSE 'D' END AS grade, CASE e WHEN 'native' THEN 90 WHEN 'tree' THEN 75 WHEN 'logical' THEN 55 ELSE 35 END AS low,
 CASE e WHEN 'native' THEN 10 WHEN 'tree' THEN 14 ELSE 19 END AS width
FROM (SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k, ['native', 'tree', 'logical', 'plain'][length(event_type) % 4 + 1] AS e FROM events))""")
def f13_chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    engine = F.element_at(F.array(*map(F.lit, ["native", "tree", "logical", "plain"])), F.length("event_type") % 4 + 1)
    grade, score = P.quality(engine, (k % 11) / 10.0, F.col("event_type") == "error", k % 7 == 0)
    return read(spark, sf_dir, "events").select("event_id", grade.alias("grade"), score.alias("score"))


@query("""SELECT event_id, CASE WHEN k < 25 THEN 'D' WHEN k < 50 THEN 'C' WHEN k < 75 THEN 'B' ELSE 'A' END AS grade, coalesce(nullif(event_type, ''), 'unknown') AS kind, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 1) AS line
FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events)""")
def p25_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades by a number in a JSON column (P25), and a citation's defaults (P22)."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    kind, line = P.citation_defaults(F.col("event_type"), k)
    return read(spark, sf_dir, "events").select("event_id", P.grade_of(k, 25, 50, 75).alias("grade"), kind.alias("kind"), line.alias("line"))


@query("SELECT user_id, left(string_agg(event_id || ' ' || event_type, '; ' ORDER BY event_id), 400) AS message FROM events WHERE event_type = 'error' GROUP BY user_id")
def p28_joined_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's errors as one text of 400 characters: so many fit at most, so only the first 200 of a user are gathered."""
    e = R.latest(read(spark, sf_dir, "events").where("event_type = 'error'"), ["user_id"], F.asc("event_id"), n=200)
    each = F.array_sort(F.collect_list(F.struct("event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("m"))))
    return e.groupBy("user_id").agg(F.left(F.array_join(F.transform(each, lambda x: x["m"]), "; "), F.lit(400)).alias("message"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 90) THEN coalesce(nullif(max(event_type) FILTER (event_type = 'error'), ''), 'Failed')
 WHEN count(*) % 2 = 0 THEN 'Processing' WHEN bool_or(event_type = 'click') THEN 'Ready' ELSE 'Not Ready' END AS status FROM events GROUP BY user_id""")
def p31_display_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    s = read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.bool_or((kind == "error") & (F.col("value") > 90)).alias("failed"), F.max(F.when(kind == "error", kind)).alias("message"),
        (F.count(F.lit(1)) % 2 == 0).alias("busy"), F.bool_or(kind == "click").alias("ready"),
    )
    return s.select("user_id", P.display_status(F.col("failed"), F.col("message"), F.col("busy"), F.col("ready")).alias("status"))


@query("""SELECT event_id, CASE WHEN value BETWEEN 0 AND 1 THEN printf('%.1f', value * 100) || '%' ELSE printf('%.3f', value) END AS shown,
 upper(event_type[1]) || lower(event_type[2:]) AS label FROM events""")
def p30_metric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = P.metric_label(F.concat(F.lit("average_"), "event_type"))
    return read(spark, sf_dir, "events").select("event_id", P.metric_text(F.col("value")).alias("shown"), label.alias("label"))


@query(f"""WITH {base._GOLD_SQL}, c AS (SELECT lang, {base._COUNTS_SQL} FROM (SELECT *, score >= 0.5 AS p FROM g) GROUP BY lang), m AS (SELECT lang, {base._RATES_SQL} FROM c)
SELECT lang, CASE WHEN recall + f1 > 0 THEN round(2 * recall * f1 / (recall + f1), 5) ELSE 0.0 END AS harmonic, row_number() OVER (ORDER BY (recall >= 0.5) DESC, f1 DESC, recall DESC, precision DESC, lang) AS place FROM m""")
def t11_sweep_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings in the order of a sweep: enough recall first, then F1, recall and precision (T11), with the harmonic mean (F26)."""
    m = E.rates(E.confusion(base._gold(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "lang"))
    order = Window.orderBy((F.col("recall") >= 0.5).desc(), F.desc("f1"), F.desc("recall"), F.desc("precision"), "lang")  # one row a setting
    return m.select("lang", F.round(P.harmonic(F.col("recall"), F.col("f1")), 5).alias("harmonic"), F.row_number().over(order).cast("long").alias("place"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(nullif(lang, ''), 'zz'), strlen(text), doc_id) AS place FROM documents""")
def t07_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.nullif("lang", F.lit("")), F.lit("zz")).alias("lang"), F.octet_length("text").alias("size"))
    return R.placed(files, "source", F.asc("lang"), F.asc("size"), F.asc("doc_id"), name="place").select("doc_id", "place")


# Identities and texts.


@query("""SELECT doc_id, sha256('{"language":"' || lang || '","options":{"max":1024},"path":"' || source || '","sha256":"' || sha256(text) || '","size":' || strlen(text) || ',"version":3}') AS fingerprint,
 '{"context":{"chars":' || n_chars || '},"language":"' || lang || '","path":"' || source || '"}' AS metadata FROM documents""")
def f04_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of canonical JSON (F04) and searchable metadata with sorted keys (F06)."""
    options, context = F.struct(F.lit(1024).alias("max")), F.struct(F.col("n_chars").alias("chars"))
    print_ = P.file_fingerprint(F.col("source"), F.sha2("text", 256), F.octet_length("text"), F.col("lang"), options, 3)
    return read(spark, sf_dir, "documents").select("doc_id", print_.alias("fingerprint"), P.chunk_metadata(F.col("source"), F.col("lang"), context).alias("metadata"))


@query("""WITH h AS (SELECT doc_id, sha256(sha256(text) || ':0:0:' || strlen(text)) AS fingerprint FROM documents), u AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('loom:' || fingerprint)) AS s FROM h)
SELECT doc_id, fingerprint, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(s, 17, 1)) - 1) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS chunk_id FROM u""")
def f05_text_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of a chunk that is the whole text: its file's hash, its number and its bytes."""
    fingerprint = F.sha2(F.concat(F.sha2("text", 256), F.lit(":0:0:"), F.octet_length("text").cast("string")), 256)
    return read(spark, sf_dir, "documents").select("doc_id", fingerprint.alias("fingerprint"), T.uuid5(F.concat(F.lit("loom:"), fingerprint)).alias("chunk_id"))


@query("""WITH l AS (SELECT doc_id, strlen(text) AS total, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE strlen(text) > 0),
b AS (SELECT doc_id, total, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)
SELECT doc_id, start AS from_byte, (total - start)::BIGINT AS overlap_bytes FROM b WHERE start < total QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abs(total - start - 205), start) = 1""")
def f15_line_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.line_overlap(read(spark, sf_dir, "documents"), 205)


@query("""SELECT doc_id, left(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' '), 240) AS signature,
 regexp_replace(regexp_replace(replace(replace(lower(source || '++#' || lang), '++', 'pp'), '#', 'sharp'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS identifier FROM documents""")
def f22_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit("++#"), "lang")
    return read(spark, sf_dir, "documents").select("doc_id", P.signature(F.col("text")).alias("signature"), P.identifier(name).alias("identifier"))


@query("""SELECT conv_id, turn, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS answer_sha256 FROM conversations""")
def f23_fenced_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants' texts stand in a fenced block here, users' don't."""
    wrapped = F.when(F.col("role") == "assistant", F.concat(F.lit("Here:\n```py\n"), "text", F.lit("\n```\nand ```more```"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(P.fenced(wrapped), 256).alias("answer_sha256"))


@query("""SELECT DISTINCT source, left(regexp_replace(regexp_replace(lower('model/' || source || ' v1'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 32) || '_64_' || left(sha256('model/' || source || ' v1'), 8) AS collection FROM documents""")
def f27_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.concat(F.lit("model/"), "source", F.lit(" v1"))
    return read(spark, sf_dir, "documents").select("source").distinct().select("source", P.collection(model, F.lit(64)).alias("collection"))


@query("SELECT page_id, array_to_string(list_slice(string_split(regexp_extract(url, '://(.*)$', 1), '/'), 1, 2), '/') AS label FROM pages")
def f37_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.substring_index(F.regexp_extract("url", "://(.*)$", 1), "/", 2).alias("label"))


@query("""SELECT doc_id, i - 1 AS block, sha256(source || ':' || (i - 1) || ':' || line) AS id, strlen(line)::BIGINT AS bytes
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def c01_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.line_blocks(read(spark, sf_dir, "documents"), "source").select("doc_id", "block", "id", F.octet_length("line").cast("long").alias("bytes"))


@query(base.ORACLES["m02_balanced_sample"].join(["SELECT '[' || string_agg(doc_id::VARCHAR, ',' ORDER BY position) || ']' AS ids, sha256('[' || string_agg(doc_id::VARCHAR, ',' ORDER BY position) || ']') AS fingerprint, count(*) AS n FROM (", ")"]))
def c12_sampling_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of a sample in order, as compact JSON, and their fingerprint; a sample is small by its count."""
    sample = base.m02_balanced_sample(spark, sf_dir)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "doc_id"))), lambda x: x["doc_id"])
    return sample.agg(F.to_json(ids).alias("ids"), F.count(F.lit(1)).alias("n")).select("ids", F.sha2("ids", 256).alias("fingerprint"), "n")


# Prompts.

_RULES, _NOTHING = "Answer from the sources alone.\n", "No source fits the question."


@query(f"""WITH {base.GATED_CTE},
heads AS (SELECT item_id, number, text, chr(10) || '[SOURCE ' || number || '] ' || source || ' (' || lang || ')' || chr(10) AS h FROM gated JOIN documents USING (doc_id)),
run AS (SELECT *, 6000 - coalesce(sum(length(h) + length(text)) OVER (PARTITION BY item_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - length(h) AS room FROM heads),
ctx AS (SELECT item_id, string_agg(h || left(text, least(length(text), room)::BIGINT), '' ORDER BY number) AS context, count(*) AS sources FROM run WHERE room > 0 GROUP BY item_id)
SELECT item_id, coalesce(sources, 0) AS sources, sha256('{_RULES.strip()}' || chr(10) || coalesce(context, '{_NOTHING}') || chr(10) || 'Question: ' || text) AS prompt_sha256 FROM benchmark LEFT JOIN ctx USING (item_id)""")
def r12_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Q.gate(base._reranked(spark, sf_dir), 0.00017189, 0.855)
    head = F.concat(F.lit("\n[SOURCE "), F.col("number").cast("string"), F.lit("] "), "source", F.lit(" ("), "lang", F.lit(")\n"))
    rows = kept.select("item_id", "number", head.alias("head"), "text", F.length(head).cast("long").alias("header_chars"), F.length("text").cast("long").alias("text_chars"))
    pieces = R.budget(rows, 6000).select("item_id", "number", F.concat("head", F.left("text", F.col("used").cast("int"))).alias("piece"))
    out = P.prompts(read(spark, sf_dir, "benchmark"), pieces, _RULES, _NOTHING)
    return out.select("item_id", "sources", F.sha2("prompt", 256).alias("prompt_sha256"))


@query(f"WITH {base.BM25_CTE} SELECT item_id, min(rank) FILTER (n_chars BETWEEN 400 AND 2000 AND lang = 'en') AS target_rank FROM kw_top JOIN documents USING (doc_id) GROUP BY item_id")
def r09_target_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = base._keyword(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    inside = F.col("n_chars").between(400, 2000) & (F.col("lang") == "en")
    return hits.groupBy("item_id").agg(F.min(F.when(inside, F.col("rank"))).alias("target_rank"))


def _field_sql(name: str, expr: str) -> str:
    return f"""t{name} AS (SELECT doc_id, list_transform(regexp_extract_all({expr}, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM documents),
s{name} AS (SELECT count(*) AS n, avg(len(t)) AS al FROM t{name}),
f{name} AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t{name}) GROUP BY ALL),
d{name} AS (SELECT term, count(*) AS df FROM f{name} GROUP BY term),
k{name} AS (SELECT item_id, doc_id, round(sum(q * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(al, 1.0)))), 6) AS score
  FROM asked JOIN f{name} USING (term) JOIN d{name} USING (term), s{name} GROUP BY ALL HAVING score > 0)"""


@query(f"""WITH asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM benchmark) GROUP BY ALL),
{_field_sql('m', "concat_ws(' ', source, lang)")}, {_field_sql('x', 'text')},
b AS (SELECT item_id, doc_id, round(sum(score), 6) AS score FROM (SELECT item_id, doc_id, 2 * score AS score FROM km UNION ALL SELECT * FROM kx) GROUP BY ALL)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b JOIN documents USING (doc_id) WHERE lang = 'en' QUALIFY rank <= 32""")
def r02_two_field_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base._documents(spark, sf_dir)
    hits = Q.two_field_top(docs, read(spark, sf_dir, "benchmark"), 32, 2.0, docs.where("lang = 'en'"))
    return Q.top(hits, 32, F.desc("score"), F.asc("doc_id")).drop("quality")
