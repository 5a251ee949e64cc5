"""Registered queries of the retrieval engine, each with independent DuckDB SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import bleu as B
from corpusloom.operators import chunking as C
from corpusloom.operators import evaluation as E
from corpusloom.operators import relational as R
from corpusloom.operators import retrieval as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Ranked retrieval: benchmark items are the questions, documents the chunks, source and lang their metadata, labels
# their quality. A question's vector is the embedding with its number, as the tables have no question vectors.


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.concat_ws(" ", "source", "lang").alias("meta"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))


def _keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.rank_channel(Q.keyword_top(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark"), 32, _quality(spark, sf_dir)), None, 32)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    asked = read(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select("item_id", F.col("embedding").alias("qvec"))
    vectors = Q.with_quality(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), _quality(spark, sf_dir))
    return Q.rank_channel(Q.dense_top(vectors, asked, 32), None, 32)


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = Q.fuse(_dense(spark, sf_dir), _keyword(spark, sf_dir))
    asked = Q.small(read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question")))
    both = fused.join(asked, "item_id").join(_documents(spark, sf_dir), "doc_id")
    head = F.concat(F.lit("Path: "), "source", F.lit("\nLanguage: "), "lang", F.lit("\n"))
    return both.withColumn("rerank", Q.overlap_score(F.col("question"), F.concat(head, "text")))


BM25_CTE = """
tok AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t, list_transform(regexp_extract_all(concat_ws(' ', source, lang), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS m FROM documents),
lens AS (SELECT doc_id, len(t) + 2.0 * len(m) AS dl FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS al FROM lens),
bag AS (SELECT doc_id, unnest(t) AS term, 1.0 AS w FROM tok UNION ALL SELECT doc_id, unnest(m), 2.0 FROM tok),
tf AS (SELECT doc_id, term, sum(w)::DOUBLE AS tf FROM bag GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM benchmark) GROUP BY ALL),
kw AS (SELECT item_id, doc_id, round(sum(q * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(al, 1.0)))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL HAVING score > 0),
qual AS (SELECT doc_id, quality::BIGINT AS quality FROM labels),
kw_top AS (SELECT item_id, doc_id, score, coalesce(quality, 0) AS quality, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, coalesce(quality, 0) DESC, doc_id) AS rank
  FROM kw LEFT JOIN qual USING (doc_id) QUALIFY rank <= 32)"""
DENSE_CTE = """
ds AS (SELECT item_id, c.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM benchmark JOIN embeddings q ON item_id = q.vec_id, embeddings c),
ds_top AS (SELECT item_id, doc_id, score, coalesce(quality, 0) AS quality, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, coalesce(quality, 0) DESC, doc_id) AS rank
  FROM ds LEFT JOIN (SELECT doc_id, quality::BIGINT AS quality FROM labels) USING (doc_id) QUALIFY rank <= 32)"""
FUSED_CTE = (
    BM25_CTE
    + ","
    + DENSE_CTE
    + """,
both_ch AS (SELECT * FROM ds_top UNION ALL SELECT * FROM kw_top),
fused AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, max(quality) AS quality, min(rank) AS best_rank FROM both_ch GROUP BY ALL),
fused_top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, quality DESC, best_rank, doc_id) AS rank FROM fused QUALIFY rank <= 20)"""
)
GATED_CTE = (
    FUSED_CTE
    + r""",
words AS (SELECT f.*, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda x: x <> '')) AS q,
  list_distinct(list_filter(regexp_split_to_array(lower('Path: ' || source || chr(10) || 'Language: ' || lang || chr(10) || d.text), '\s+'), lambda x: x <> '')) AS p
  FROM fused_top f JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
scored AS (SELECT item_id, doc_id, rank, quality, round(len(list_intersect(q, p)) / greatest(len(q), 1), 6) AS rerank FROM words),
held AS (SELECT *, max(rerank) OVER (PARTITION BY item_id) AS best FROM scored),
gated AS (SELECT item_id, doc_id, rank, quality, rerank, row_number() OVER (PARTITION BY item_id ORDER BY rerank DESC, quality DESC, rank) AS number
  FROM held WHERE rerank >= greatest(0.00017189, best * 0.855) QUALIFY number <= 5)"""
)


@query(f"WITH {BM25_CTE} SELECT item_id, doc_id, score, quality, rank FROM kw_top")
def r01_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir).select("item_id", "doc_id", "score", "quality", "rank")


@query(f"WITH {DENSE_CTE} SELECT item_id, doc_id, score, quality, rank FROM ds_top")
def r08_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("item_id", "doc_id", "score", "quality", "rank")


@query(f"WITH {FUSED_CTE} SELECT item_id, doc_id, score, quality, best_rank, rank FROM fused_top")
def r03_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.fuse(_dense(spark, sf_dir), _keyword(spark, sf_dir)).select("item_id", "doc_id", "score", "quality", "best_rank", "rank")


@query(f"WITH {GATED_CTE} SELECT item_id, doc_id, rank, quality, rerank, number FROM gated")
def r11_hybrid_answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.gate(_reranked(spark, sf_dir), 0.00017189, 0.855).select("item_id", "doc_id", "rank", "quality", "rerank", "number")


@query(
    f"""WITH {GATED_CTE},
heads AS (SELECT item_id, number, doc_id, length(chr(10) || '[SOURCE ' || number || '] ' || source || ' (' || lang || ')' || chr(10)) AS h, length(text) AS n
  FROM gated JOIN documents USING (doc_id)),
run AS (SELECT *, 6000 - coalesce(sum(h + n) OVER (PARTITION BY item_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - h AS room FROM heads)
SELECT item_id, number, doc_id, h::BIGINT AS header_chars, n::BIGINT AS text_chars, least(n, room)::BIGINT AS used FROM run WHERE room > 0"""
)
def w04_prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Q.gate(_reranked(spark, sf_dir), 0.00017189, 0.855)
    head = F.concat(F.lit("\n[SOURCE "), F.col("number").cast("string"), F.lit("] "), "source", F.lit(" ("), "lang", F.lit(")\n"))
    rows = kept.select("item_id", "number", "doc_id", F.length(head).cast("long").alias("header_chars"), F.length("text").cast("long").alias("text_chars"))
    return R.budget(rows, 6000)


# Scalar functions and file routing.


@query("""SELECT page_id, path, CASE
 WHEN list_has_any(string_split(lower(path), '/'), ['node_modules','vendor','dist','build','coverage','.next','.venv']) THEN 'generated_or_dependency_path'
 WHEN regexp_matches(path, '\\.min\\.(js|mjs|cjs)$') THEN 'minified_file'
 WHEN page_id % 6 = 4 THEN 'unsupported_language' END AS reason
FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'Dist/bundle.js' WHEN 2 THEN 'src/b.min.js' WHEN 3 THEN 'src/b.MIN.js'
 WHEN 4 THEN 'assets/logo.PNG' ELSE 'x/' || regexp_extract(url, '://[^/]*/(.*)$', 1) END AS path FROM pages)""")
def p01_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 6
    path = (
        F.when(k == 0, "src/a.py").when(k == 1, "Dist/bundle.js").when(k == 2, "src/b.min.js").when(k == 3, "src/b.MIN.js")
        .when(k == 4, "assets/logo.PNG").otherwise(F.concat(F.lit("x/"), F.regexp_extract("url", "://[^/]*/(.*)$", 1)))
    )
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("reason", T.skip_reason(F.col("path")))


@query("""SELECT page_id, path, CASE
 WHEN list_has_any(string_split(lower(path), '/'), ['node_modules','vendor','dist','build','coverage','.next','.venv']) THEN 'generated_or_dependency_path'
 WHEN regexp_matches(path, '\\.min\\.(js|mjs|cjs)$') THEN 'minified_file'
 WHEN list_contains(['7z','avi','bmp','class','doc','docx','eot','gif','gz','ico','jar','jpeg','jpg','lockb','mov','mp3','mp4','o','obj','otf','pdf','png','pyc',
  'so','tar','ttf','wav','webm','webp','woff','woff2','xls','xlsx','zip'], lower(regexp_extract(path, '\\.([^./]+)$', 1))) THEN 'unsupported_language' END AS reason
FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path FROM pages)""")
def p01_page_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p01_skip_reason, for the path of every page's own url."""
    path = F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("reason", T.skip_reason(F.col("path")))


@query("""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty_file'
 WHEN regexp_matches(lower(array_to_string(list_slice(string_split_regex(text, '\\r?\\n'), 1, 6), chr(10))), '@generated|code generated|do not edit') THEN 'generated_file'
 WHEN length(text) > 20000 AND list_max(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: length(x))) > 10000 THEN 'minified_file' END AS problem FROM documents) GROUP BY 1""")
def p06_content_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(T.content_problem(F.col("text")).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS contents FROM documents GROUP BY source")
def a14_manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("source", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    by_content = d.groupBy("source", "sha256").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    return by_content.groupBy("source").agg(F.sum("n").alias("files"), F.sum("s").alias("bytes"), F.count(F.lit(1)).alias("contents"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def a23_duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("""WITH h AS (SELECT doc_id, sha256('loom:' || doc_id || ':0') AS fingerprint, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('loom:' || doc_id)) AS s FROM documents)
SELECT doc_id, fingerprint, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(s, 17, 1)) - 1) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS chunk_id FROM h""")
def f05_chunk_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("loom:"), F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(name, F.lit(":0")), 256).alias("fingerprint"), T.uuid5(name).alias("chunk_id"))


@query("""SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN (event_id % 50) * 0.001 WHEN 1 THEN event_id % 50 WHEN 2 THEN (event_id % 50) * 60 + 2.5 ELSE (event_id % 50) * 3600.0 + 60 END, 6) AS seconds,
 least(pow(2, event_id % 7), 30)::DOUBLE AS delay, (ceil(strlen(props) / 2.0) + 50)::BIGINT AS tokens FROM events""")
def f30_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = (F.col("event_id") % 50).cast("string"), F.col("event_id") % 4
    text = F.when(k == 0, F.concat(n, F.lit("ms"))).when(k == 1, F.concat(n, F.lit("s"))).when(k == 2, F.concat(n, F.lit("m2.5s"))).otherwise(F.concat(n, F.lit("h1m")))
    return read(spark, sf_dir, "events").select(
        "event_id", F.round(T.duration_seconds(text), 6).alias("seconds"), T.backoff(F.col("event_id") % 7).alias("delay"), T.token_estimate(F.length("props"), 50).alias("tokens")
    )


# History, jobs, lineage.


@query("""WITH a AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer, lead(turn) OVER w AS answer_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, answer_turn, length(text) + length(answer) AS chars FROM a WHERE role = 'user' AND next_role = 'assistant'),
t AS (SELECT *, row_number() OVER w AS pair, (sum(chars) OVER w)::BIGINT AS total FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, answer_turn, pair, total FROM t WHERE 2 * pair <= 6 AND total <= 1500""")
def w03_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.history_window(read(spark, sf_dir, "conversations"), 6, 1500)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1")
def j18_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return R.latest(done, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 2")
def w06_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expired(read(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "rn")


@query("SELECT event_id, user_id, (event_id % 3 + 1)::BIGINT AS attempt FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 1")
def w07_claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = read(spark, sf_dir, "events").where("event_type = 'click'")
    return due.orderBy("ts", "event_id").limit(1).select("event_id", "user_id", (F.col("event_id") % 3 + 1).alias("attempt"))


_JOBS_SQL = """jobs AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' WHEN 2 THEN 'failed' ELSE 'succeeded' END AS status,
 CASE WHEN event_id % 4 = 0 THEN event_id % 97 END AS lease_expires_at, event_id % 5 AS attempt_count, event_id % 3 = 0 AS transient FROM events)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(k == 0, "running").when(k == 1, "queued").when(k == 2, "failed").otherwise("succeeded").alias("status"),
        F.when(k == 0, F.col("event_id") % 97).alias("lease_expires_at"), (F.col("event_id") % 5).alias("attempt_count"), (F.col("event_id") % 3 == 0).alias("transient"),
    )


@query(f"""WITH {_JOBS_SQL} SELECT id, CASE WHEN status = 'running' AND lease_expires_at < 50 THEN 'queued' ELSE status END AS status,
 CASE WHEN status = 'running' AND lease_expires_at < 50 THEN NULL ELSE lease_expires_at END AS lease_expires_at, attempt_count FROM jobs""")
def p16_lease_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.requeued(_jobs(spark, sf_dir), F.lit(50)).select("id", "status", "lease_expires_at", "attempt_count")


@query(f"""WITH {_JOBS_SQL} SELECT id, CASE WHEN transient AND attempt_count < 3 THEN 'queued' ELSE 'failed' END AS next_status,
 CASE WHEN transient AND attempt_count < 3 THEN pow(2.0, attempt_count)::DOUBLE END AS delay FROM jobs WHERE status = 'failed'""")
def x03_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.after_failure(_jobs(spark, sf_dir).where("status = 'failed'")).select("id", "next_status", "delay")


@query("""SELECT user_id, count(*) AS jobs, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0.0), 4) AS click_value,
 round((count(*) FILTER (WHERE event_type = 'click'))::DOUBLE / count(*), 6) AS progress FROM events GROUP BY user_id""")
def a11_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = F.col("event_type") == "click"
    return read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(click).alias("clicks"), F.round(F.coalesce(F.sum(F.when(click, F.col("value"))), F.lit(0.0)), 4).alias("click_value"),
        F.round(F.count_if(click) / F.count(F.lit(1)), 6).alias("progress"),
    )


@query("""SELECT c_custkey, n_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS chat_ready
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_name = 'EUROPE')""")
def j10_chat_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    mine = read(spark, sf_dir, "customer").join(allowed, F.col("c_nationkey") == F.col("n_nationkey"))
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("done")).distinct()
    return mine.join(done, "c_custkey", "left").select("c_custkey", "n_name", F.coalesce("done", F.lit(False)).alias("chat_ready"))


@query("""SELECT doc_id, EXISTS (SELECT 1 FROM documents s WHERE s.source <> 'src0' AND s.text = d.text AND s.lang = d.lang) AS reused FROM documents d WHERE source = 'src0'""")
def j06_incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("sha256"))
    have, need = R.reusable(d.where("source = 'src0'"), d.where("source <> 'src0'"), ["lang", "sha256"])
    return have.select("doc_id", F.lit(True).alias("reused")).unionByName(need.select("doc_id", F.lit(False).alias("reused")))


@query("""SELECT doc_id AS id, sha256(text) AS content_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND d.n_chars % 3 <> 0)""")
def j11_pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), "n_chars")
    old = F.when(F.col("n_chars") % 3 == 0, F.lit("changed")).otherwise(F.col("content_hash"))
    stored = d.select("id", old.alias("content_hash")).join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_semi")
    return R.pending(d.select("id", "content_hash"), stored).select("id", "content_hash")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def j09_orphan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("""SELECT id, version, value FROM (SELECT user_id AS id, event_id AS version, value, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'click')::INT DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def k04_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "value", "event_type")
    cols = ["id", "version", "value"]
    return R.upsert(e.where("event_type <> 'click'").select(*cols), e.where("event_type = 'click'").select(*cols), ["id"]).select(*cols)


@query("""WITH s AS (SELECT source, count(*) AS n, avg(CASE WHEN lang NOT IN ('de', 'es') THEN 1.0 ELSE 0.0 END) AS code, max(n_chars) AS largest, count(DISTINCT lower(lang)) AS langs FROM documents GROUP BY source)
SELECT source, CASE WHEN n >= 30 AND code < 0.6 AND largest <= 256 THEN 'small' WHEN code < 0.6 AND langs > 1 THEN 'multilingual' ELSE 'default' END AS choice, n, langs FROM s""")
def r07_model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(~F.col("lang").isin("de", "es"), 1.0).otherwise(0.0)).alias("code"), F.max("n_chars").alias("largest"), F.count_distinct(F.lower("lang")).alias("langs")
    )
    prose = F.col("code") < 0.6
    choice = F.when((F.col("n") >= 30) & prose & (F.col("largest") <= 256), "small").when(prose & (F.col("langs") > 1), "multilingual").otherwise("default")
    return s.select("source", choice.alias("choice"), "n", "langs")


# Evaluation. Gold is a label's toxic flag, predictions and scores come from the text's length.

_GOLD_SQL = "g AS (SELECT doc_id, lang, toxic::INT AS gold, (n_chars % 1000) / 1000.0 AS score FROM documents JOIN labels USING (doc_id))"
_RATES_SQL = """CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1, CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) / (tp + fp + fn + tn), 6) ELSE 0.0 END AS accuracy"""
_COUNTS_SQL = "count(*) FILTER (WHERE gold = 1 AND p) AS tp, count(*) FILTER (WHERE gold = 0 AND p) AS fp, count(*) FILTER (WHERE gold = 1 AND NOT p) AS fn, count(*) FILTER (WHERE gold = 0 AND NOT p) AS tn"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return both.select("doc_id", "lang", F.col("toxic").alias("gold"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"))


@query(f"WITH {_GOLD_SQL}, c AS (SELECT lang, {_COUNTS_SQL} FROM (SELECT *, score >= 0.5 AS p FROM g) GROUP BY lang) SELECT lang, tp, fp, fn, tn, {_RATES_SQL} FROM c")
def a05_confusion_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rates(E.confusion(_gold(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "lang"))


@query(f"WITH {_GOLD_SQL}, c AS (SELECT {_COUNTS_SQL} FROM (SELECT *, score >= 0.5 AS p FROM g)) SELECT tp, fp, fn, tn, {_RATES_SQL} FROM c")
def a07_micro_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.micro(E.confusion(_gold(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "lang"))


@query(f"""WITH {_GOLD_SQL}, c AS (SELECT threshold, {_COUNTS_SQL} FROM (SELECT g.*, t.threshold, score >= t.threshold AS p FROM g, (SELECT i / 10.0 AS threshold FROM range(11) r(i)) t) GROUP BY threshold)
SELECT threshold::DOUBLE AS threshold, tp, fp, fn, tn, {_RATES_SQL} FROM c""")
def r17_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sweep(_gold(spark, sf_dir), spark.range(11).select((F.col("id") / 10.0).cast("double").alias("threshold")))


@query(f"""WITH {GATED_CTE}, f AS (SELECT item_id, min(rank) FILTER (WHERE quality = 1) AS r FROM kw_top GROUP BY item_id)
SELECT round(coalesce(avg(1.0 / r), 0.0), 6) AS mrr_recovered, round(coalesce(avg(coalesce(1.0 / r, 0.0)), 0.0), 6) AS mrr, count(r) AS recovered, count(*) AS questions FROM f""")
def a09_reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reciprocal_ranks(_keyword(spark, sf_dir), F.col("quality") == 1)


@query("""WITH o AS (SELECT lang, row_number() OVER (ORDER BY sha256('42|' || lang), lang) AS g FROM (SELECT DISTINCT lang FROM documents)),
r AS (SELECT doc_id, d.lang, g, row_number() OVER (PARTITION BY d.lang ORDER BY sha256('42|' || doc_id), doc_id) AS n FROM documents d JOIN o USING (lang))
SELECT doc_id, lang, n, row_number() OVER (ORDER BY n, g) AS position FROM r WHERE n <= 30 // 4 + CASE WHEN g <= 30 % 4 THEN 1 ELSE 0 END""")
def m02_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.balanced_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 30, "42")


@query("""WITH b AS (SELECT doc_id, (n_chars % 40)::BIGINT AS lo, (n_chars % 40 + 20)::BIGINT AS hi, text FROM documents)
SELECT doc_id, CASE WHEN (lo <= doc_id % 50 AND hi >= doc_id % 50 + 3 AND (trim(substr(text, 3, 5)) = '' OR contains(text, trim(substr(text, 3, 5))))) OR (lo <= 25 AND hi >= 26 AND contains(text, 'th')) THEN 1 ELSE 0 END AS label FROM b""")
def j13_span_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array(
        F.struct((F.col("doc_id") % 50).alias("lo"), (F.col("doc_id") % 50 + 3).alias("hi"), F.substring("text", 3, 5).alias("text")),
        F.struct(F.lit(25).cast("long").alias("lo"), F.lit(26).cast("long").alias("hi"), F.lit("th").alias("text")),
    )
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 40).alias("lo"), (F.col("n_chars") % 40 + 20).alias("hi"), "text", spans.alias("spans"))
    return E.span_labels(d).select("doc_id", "label")


# Intervals and time.


@query("""SELECT user_id, event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS spent FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def w16_rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("at", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-59, 0)
    return e.select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("requests"), F.round(F.sum("value").over(w), 4).alias("spent"))


@query("""WITH p AS (SELECT user_id, event_id AS id, epoch_us(ts) AS at FROM events WHERE event_type <> 'click'), c AS (SELECT user_id, event_id AS event, epoch_us(ts) AS time FROM events WHERE event_type = 'click')
SELECT p.user_id, p.id, (SELECT arg_max(event, (time, event)) FROM c WHERE c.user_id = p.user_id AND c.time <= p.at) AS event FROM p""")
def j20_nearest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    points = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("id"), F.col("us").alias("at"))
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("event"), F.col("us").alias("time"))
    return R.nearest_before(points, clicks, "user_id")


_SPANS_SQL = "s AS (SELECT l_suppkey AS key, l_orderkey * 10 + l_linenumber AS id, (l_partkey * 7 + l_orderkey) % 20000 AS lo, (l_partkey * 7 + l_orderkey) % 20000 + l_quantity::BIGINT AS hi FROM lineitem)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = (F.col("l_partkey") * 7 + F.col("l_orderkey")) % 20000
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long")).alias("hi")
    )


@query(f"WITH {_SPANS_SQL} SELECT a.key, a.id AS a_id, b.id AS b_id FROM s a JOIN s b ON a.key = b.key AND a.lo < b.hi AND a.hi > b.lo WHERE a.id < b.id AND a.hi > a.lo AND b.hi > b.lo")
def j21_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    return R.overlaps(s, s, "key", 64).where("a_id < b_id").select("key", "a_id", "b_id")


@query(f"""WITH {_SPANS_SQL}, d AS (SELECT key, lo, hi, count(*) AS copies FROM s GROUP BY ALL)
SELECT key, lo, hi, copies FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.key = a.key AND b.lo <= a.lo AND b.hi >= a.hi AND (b.lo < a.lo OR b.hi > a.hi))""")
def j22_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_level(_spans(spark, sf_dir), "key", "lo", "hi").select("key", "lo", "hi", "copies")


# Chunking and text similarity: checked by invariants and by tests.


@query("SELECT doc_id, sha256(text) AS joined_sha256, strlen(text) AS n_bytes, true AS within FROM documents WHERE strlen(text) > 0")
def c03_lossless_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = C.chunk_text(read(spark, sf_dir, "documents"), 1024)
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk")))
    joined = F.array_join(F.transform(ordered, lambda c: c["chunk"]), "")
    return chunks.groupBy("doc_id").agg(
        F.sha2(joined, 256).alias("joined_sha256"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("n_bytes"),
        (F.max(F.col("byte_end") - F.col("byte_start")) <= 1024).alias("within"),
    )


@query()
def c02_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.line_windows(read(spark, sf_dir, "documents")).withColumn("chunk_sha256", F.sha2("chunk", 256)).drop("chunk")


@query()
def f24_bleu_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    return c.select("conv_id", "turn", F.round(B.bleu("text", "before"), 6).alias("bleu"))
