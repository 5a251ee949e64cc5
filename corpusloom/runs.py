"""Registered queries over evaluation runs: tuning grids, admission by rate, answers against the functions they repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import queries as base
from corpusloom.functions import text as T
from corpusloom.operators import limits, needles
from corpusloom.operators import projections as P
from corpusloom.operators import retrieval as Q
from corpusloom.operators.stages import stored
from corpusloom.queries import query, read

RATIOS, RELATIVES = [0.5, 1.0, 2.0], [0.0, 0.6, 0.855, 1.0]
THRESHOLDS = 26


@query(rf"""WITH {base.BM25_CTE}, {base.DENSE_CTE},
ch AS (SELECT *, true AS dense FROM ds_top UNION ALL SELECT *, false FROM kw_top),
fw AS (SELECT dense_weight, item_id, doc_id, round(sum(CASE WHEN dense THEN dense_weight ELSE 1.0 END / (60 + rank)), 9) AS score, max(quality) AS quality, min(rank) AS best_rank FROM ch, (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS dense_weight) GROUP BY ALL),
pool AS (SELECT dense_weight, item_id, doc_id, quality FROM fw QUALIFY row_number() OVER (PARTITION BY dense_weight, item_id ORDER BY score DESC, quality DESC, best_rank, doc_id) <= 20),
wd AS (SELECT pool.*, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda x: x <> '')) AS q, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\s+'), lambda x: x <> '')) AS p
 FROM pool JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
x AS (SELECT dense_weight, item_id, quality AS gold, round(len(list_intersect(q, p)) / greatest(len(q), 1), 6)::DOUBLE AS score FROM wd),
f AS (SELECT x.*, relative, max(score) OVER (PARTITION BY dense_weight, relative, item_id) * relative AS floor FROM x, (SELECT unnest([0.0, 0.6, 0.855, 1.0])::DOUBLE AS relative)),
t AS (SELECT i / 25.0::DOUBLE AS threshold FROM range({THRESHOLDS}) r(i)),
e AS (SELECT dense_weight, relative, threshold, item_id, count(*) FILTER (score >= greatest(threshold, floor)) AS n, count(*) FILTER (score >= greatest(threshold, floor) AND gold = 1) AS tp, count(*) FILTER (gold = 1) AS g FROM f, t GROUP BY ALL),
s AS (SELECT dense_weight, relative, threshold, round(avg((n = 0)::INT), 6) AS empty_rate, round(coalesce(avg((n = 0)::INT) FILTER (g = 0), 0.0), 6) AS negative_abstention, round(avg(n), 6) AS mean_chunks,
 sum(tp)::BIGINT AS tp, (sum(n) - sum(tp))::BIGINT AS fp, (sum(g) - sum(tp))::BIGINT AS fn FROM e GROUP BY ALL)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM s""")
def r18_sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All settings of dense weight, threshold and relative limit over the reranked pools of the benchmark's questions."""
    dense, keyword = stored(base._dense(spark, sf_dir)), stored(base._keyword(spark, sf_dir))
    pools = None
    for w in RATIOS:
        p = Q.fuse(dense, keyword, dense_weight=w).select(F.lit(w).alias("dense_weight"), "item_id", "doc_id", F.col("quality").alias("gold"))
        pools = p if pools is None else pools.unionByName(p)
    pools = stored(pools)
    asked = Q.small(read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question")))
    met = pools.select("item_id", "doc_id").distinct().join(asked, "item_id").join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    scores = met.select("item_id", "doc_id", Q.overlap_score(F.col("question"), F.col("text")).alias("score"))  # once, whatever the weights
    scored = pools.join(scores, ["item_id", "doc_id"]).withColumnRenamed("item_id", "example")
    thresholds = spark.range(THRESHOLDS).select((F.col("id") / 25.0).alias("threshold"))
    told = P.sweep_statistics(scored, thresholds, RELATIVES, ["dense_weight"])
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return told.withColumns({"precision": F.round(T.ratio(tp, tp + fp), 6), "recall": F.round(T.ratio(tp, tp + fn), 6), "f1": F.round(T.ratio(2 * tp, 2 * tp + fp + fn), 6)})


PER_MINUTE, TOKENS = 3, 220


@query(f"""WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS id, epoch_us(date_trunc('hour', ts)) + (event_id % 90) * 1000000 AS "at", strlen(props)::BIGINT + 40 + event_id % 200 AS tokens FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at", id) AS n FROM r),
run AS (SELECT key, 0::BIGINT AS id, 0::BIGINT AS "at", 0::BIGINT AS tokens, 0::BIGINT AS n, NULL::BIGINT AS admitted, NULL::BIGINT AS last, []::STRUCT(t BIGINT, k BIGINT)[] AS w FROM (SELECT DISTINCT key FROM r)
 UNION ALL SELECT key, id, "at", tokens, n, admitted, coalesce(admitted, last), CASE WHEN admitted IS NULL THEN w ELSE list_append(list_filter(w, lambda x: x.t > admitted - 60000000), {{'t': admitted, 'k': tokens}}) END FROM (
  SELECT o.key, o.id, o."at", o.tokens, o.n, run.last, run.w, CASE WHEN o.tokens <= {TOKENS} THEN list_min(list_filter(list_append(list_transform(run.w, lambda x: x.t + 60000000), greatest(o."at", coalesce(run.last + {60000000 // PER_MINUTE}, 0))),
   lambda c: c >= greatest(o."at", coalesce(run.last + {60000000 // PER_MINUTE}, 0)) AND len(list_filter(run.w, lambda x: x.t > c - 60000000)) < {PER_MINUTE}
    AND coalesce(list_sum(list_transform(list_filter(run.w, lambda x: x.t > c - 60000000), lambda x: x.k)), 0) + o.tokens <= {TOKENS})) END AS admitted
  FROM run JOIN o ON o.key = run.key AND o.n = run.n + 1))
SELECT key, id, "at", tokens, admitted AS admitted_at, admitted - "at" AS waited FROM run WHERE n > 0""")
def x06_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as requests, all within a minute and a half of their hour."""
    at = F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))) + (F.col("event_id") % 90) * 1_000_000
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), at.alias("at"), (F.octet_length("props") + 40 + F.col("event_id") % 200).alias("tokens"))
    return limits.admissions(e, PER_MINUTE, TOKENS)


# A conversation's user turns are needles, its assistant turns answers; every third answer repeats a needle but for its last words.
_ANSWERS = r"""t AS (SELECT conv_id // 8 AS corpus, conv_id * 1000 + turn AS id, role, text, lag(text) OVER w AS before, lag(conv_id * 1000 + turn) OVER w AS before_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT corpus, id AS place, 'f' || id AS name, text FROM t WHERE role = 'user'),
a AS (SELECT corpus, id AS item_id, CASE WHEN id % 3 = 0 THEN regexp_replace(before, '\s+\S+$', '') ELSE text END AS text, 'f' || before_id AS truth FROM t WHERE role = 'assistant' AND before IS NOT NULL)"""


@query(rf"""WITH {_ANSWERS},
aw AS (SELECT corpus, item_id, truth, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM a), nw AS (SELECT corpus, place, name, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM n),
ag AS (SELECT corpus, item_id, k, g, count(*) AS c FROM (SELECT corpus, item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g FROM aw, range(1, 5) r(k)) GROUP BY ALL),
ng AS (SELECT corpus, place, k, g, count(*) AS c FROM (SELECT corpus, place, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g FROM nw, range(1, 5) r(k)) GROUP BY ALL),
h AS (SELECT item_id, place, k, sum(least(ag.c, ng.c)) AS hits FROM ag JOIN ng USING (corpus, k, g) GROUP BY ALL),
pr AS (SELECT aw.item_id, nw.place, name, len(aw.w) AS c, len(nw.w) AS r, x.k, coalesce(hits, 0) AS hits FROM aw JOIN nw USING (corpus) CROSS JOIN range(1, 5) x(k) LEFT JOIN h ON h.item_id = aw.item_id AND h.place = nw.place AND h.k = x.k),
sm AS (SELECT *, count(*) FILTER (hits = 0 AND k > 1) OVER (PARTITION BY item_id, place ORDER BY k) AS z FROM pr),
pn AS (SELECT item_id, place, name, c, r, k, (CASE WHEN hits > 0 THEN hits::DOUBLE WHEN k = 1 OR c <= 1 THEN 0.0 ELSE ln(c) / (pow(2, z) * 5) END) / greatest(1, c - k + 1) AS p FROM sm),
b AS (SELECT item_id, place, name, CASE WHEN min(p) > 0 THEN exp(sum(ln(CASE WHEN p > 0 THEN p ELSE 1 END)) / 4) * CASE WHEN any_value(c) > any_value(r) THEN 1.0 ELSE exp(1 - any_value(r) / any_value(c)) END ELSE 0.0 END AS s FROM pn GROUP BY ALL),
best AS (SELECT * FROM b WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, place) = 1)
SELECT a.item_id, name AS best_target, round(coalesce(s, 0.0), 6) AS best_similarity, (coalesce(name = truth AND s >= 0.8, false))::INT::DOUBLE AS pass_at_1 FROM a LEFT JOIN best USING (item_id)""")
def r10_best_needle(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").select(
        F.expr("conv_id div 8").alias("corpus"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text",
        F.lag("text").over(w).alias("before"), F.lag(F.col("conv_id") * 1000 + F.col("turn")).over(w).alias("before_id"),
    )
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    functions = turns.where("role = 'user'").select("corpus", F.col("id").alias("place"), name("id").alias("name"), "text")
    said = F.when(F.col("id") % 3 == 0, F.regexp_replace("before", r"\s+\S+$", "")).otherwise(F.col("text"))
    answers = turns.where("role = 'assistant' and before is not null").select("corpus", F.col("id").alias("item_id"), said.alias("text"), name("before_id").alias("truth"))
    return needles.best_needles(answers, functions, ["corpus"])
