"""The registered queries of this subpackage: opN_<name>(spark, sf_dir), and DuckDB SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import centroids, dac, decontaminate, divergence, kneserney, linededup, media, packing, setsketch, sharding, suffixdedup, toxicity, urlfilter

SHARDS = 16


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.kept_digest(suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), 50))


def op3_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 1, 2048, added=True)


#: The rules of op4: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.filter_pages(table(spark, sf_dir, "pages"), rules)


OP4_SQL = """
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
part AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hit AS (SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM part JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM part LEFT JOIN hit USING (page_id)
"""


def op5_setsketch_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_tokens(spark, dac.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 0, added=True))


def op7_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_text_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneserney.fit(docs, table(spark, sf_dir, "labels"))
    return kneserney.classify(docs, model).select("doc_id", "lang", "perplexity", "judged", "limit", "rejected", (~F.col("rejected")).alias("kept"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"), least=3, top=200)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
total AS (SELECT lang, source, sum(n) AS total FROM cell GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v)::HUGEINT AS p,
  1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + v)::HUGEINT AS q FROM cell JOIN total USING (lang, source) JOIN v USING (lang)),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value FROM groups g
  JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN summed s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value,
    row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS rank FROM p WHERE n > 0 AND p > q) WHERE rank <= 200)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
"""


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.kept_digest(linededup.drop_repeated_lines(table(spark, sf_dir, "documents"), least=10))


OP12_SQL = r"""
WITH blank AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS b),
split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
keyed AS (SELECT doc_id, i, line, translate(trim(line, b), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line, blank),
many AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT keyed.doc_id, i, line, many.k IS NOT NULL AND keyed.doc_id <> many.first AS gone FROM keyed LEFT JOIN many USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64)


def _op13_sql() -> str:
    sql = """
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept),
start AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16),
c0 AS (SELECT c, i, x FROM start JOIN v USING (vec_id))"""
    for r in range(4):
        sql += f""",
d{r} AS (SELECT vec_id, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN c{r} m USING (i) GROUP BY vec_id, c),
a{r} AS (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
        if r < 3:
            sql += f""",
m{r} AS (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM v JOIN a{r} USING (vec_id) GROUP BY c, i),
c{r + 1} AS (SELECT c, i, coalesce(m{r}.x, c{r}.x)::BIGINT AS x FROM c{r} LEFT JOIN m{r} USING (c, i))"""
    return sql + """,
digest AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c3 GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a3 JOIN digest USING (c)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_label_sharding, op2_repeat_removal, op3_tier_packing, op4_url_rules, op5_setsketch_links, op6_token_codes, op7_kernel_toxicity, op8_text_media, op9_benchmark_leaks, op10_quality_perplexity, op11_source_divergence, op12_line_runs, op13_centroid_clusters]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_rules": OP4_SQL, "op11_source_divergence": OP11_SQL, "op12_line_runs": OP12_SQL, "op13_centroid_clusters": _op13_sql()}
