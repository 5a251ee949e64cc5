"""Registered queries over source files: detection of languages, chunks with context and overlap, declarations.

The tables have no source code, so files are derived from them: a document's sentences become lines, some of which
begin a declaration, import something, close a bracket or follow a blank line, by their first letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import languages as L
from corpusloom.operators import evaluation as E
from corpusloom.operators import records as P
from corpusloom.operators import retrieval as Q
from corpusloom.operators import sourcecode as S
from corpusloom.operators.stages import stored
from corpusloom.queries import ORACLES, query, read

#: Pattern and replacement, in order; a line has at most 250 characters.
SHAPED = [
    ("[.] ", ".\n"),
    (r"(^|\n)([A-E][A-Za-z]*) ([A-Za-z]+)", r"\1def \3(\2) {"),
    (r"(^|\n)([S-U][^\n]*)", r"\1\2 }"),
    (r"(^|\n)(I[A-Za-z]*) ", r'\1import "\2" '),
    (r"(^|\n)(O[A-Za-z]* )", "\\1\n\\2"),
    (r"([^\n]{240})", "\\1\n"),
]
ENDINGS = [".py", ".zz", ".md", ".rs", "", ".h", "/Makefile", ".app.src", ".es", "/Dockerfile.x", "/readme.c"]


#: SHAPED for Java, without looking at any character as often as its line is long: a match begins a line, or where the last one ended.
_BEGINS = "(?dm)^"
_LINEAR = [
    ("[.] ", ".\n"),
    (_BEGINS + "([A-E][A-Za-z]*+) ([A-Za-z]++)", "def $2($1) {"),
    (_BEGINS + r"([S-U][^\n]*+)", "$1 }"),
    (_BEGINS + "(I[A-Za-z]*+) ", 'import "$1" '),
    (_BEGINS + "(O[A-Za-z]*+ )", "\n$1"),
    (_BEGINS + r"([^\n]{240})|\G([^\n]{240})", "$1$2\n"),
]


def _shaped(text: Column) -> Column:
    for pattern, put in _LINEAR:
        text = F.regexp_replace(text, pattern, put)
    return text


def _shaped_sql() -> str:
    out = "coalesce(text, '')"
    for pattern, put in SHAPED:
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    return out


def source_files(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, path, text: documents as source files; and more of their columns."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/f"), F.col("doc_id").cast("string"), ending)
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), _shaped(F.col("text")).alias("text"), *more)


_FILES = f"""files AS (SELECT doc_id, 'src/' || source || '/' || lang || '/f' || doc_id ||
 ({ENDINGS})[doc_id % {len(ENDINGS)} + 1] AS path, {_shaped_sql()} AS text FROM documents)"""
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8232) || chr(8233) || chr(8239) || chr(12288) || chr(65279)"
_WS = r"[\t\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_DECLARES = rf"(?i)^{_WS}*(?:(?:{'|'.join(L.BEFORE_DECLARING)}){_WS}+)*({'|'.join(L.DECLARING)}){_WS}+([A-Za-z_$][A-Za-z0-9_$.-]*)"
#: line: each line with its \n (nl), bytes and depth of brackets; blocks by windows.
_LINES = f"""split AS (SELECT doc_id, path, string_split(text, chr(10)) AS ls, strlen(text) AS total FROM files),
raw AS (SELECT doc_id, path, total, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
placed AS (SELECT *, strlen(line) + (i < n)::INT AS bytes, length(regexp_replace(line, '[^({{\\[]', '', 'g')) - length(regexp_replace(line, '[^)}}\\]]', '', 'g')) AS net FROM raw),
summed AS (SELECT *, (sum(bytes) OVER w)::BIGINT AS upto, (sum(net) OVER w)::BIGINT AS s FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
line AS (SELECT *, upto - bytes AS start, s - least(0, min(s) OVER w) AS depth FROM summed WHERE bytes > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
marked AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before, regexp_matches(line, '{_DECLARES}') AS declares FROM line),
cut AS (SELECT doc_id, start AS place FROM marked WHERE declares AND start > 0 AND before = 0
 UNION SELECT doc_id, upto FROM marked WHERE depth = 0 AND trim(line, {_BLANKS}) = '' UNION SELECT doc_id, total FROM marked),
block AS (SELECT doc_id, row_number() OVER w - 1 AS block, lag(place, 1, 0) OVER w AS byte_start, place AS byte_end FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY place))"""


@query(f"WITH {_FILES}, {_LINES} SELECT doc_id, block, byte_start, byte_end FROM block")
def c04_logical_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.logical_blocks(source_files(spark, sf_dir))


# Two greedy scans: blocks of more than 1024 bytes are cut behind the last line in reach, then neighbours are merged while they fit.
_CHUNKS = f"""{_LINES}, ends AS (SELECT doc_id, list(upto ORDER BY upto) AS ends FROM line GROUP BY doc_id),
part AS (SELECT doc_id, byte_start AS lo, byte_end AS stop, list_max(list_filter(ends, lambda x: x <= least(byte_start + 1024, byte_end))) AS hi, ends FROM block JOIN ends USING (doc_id)
 UNION ALL SELECT doc_id, hi, stop, list_max(list_filter(ends, lambda x: x <= least(hi + 1024, stop))), ends FROM part WHERE hi < stop),
units AS (SELECT doc_id, list(hi ORDER BY hi) AS units, max(hi) AS total FROM part GROUP BY doc_id),
hop AS (SELECT doc_id, 0::BIGINT AS lo, list_max(list_filter(units, lambda x: x <= 1024)) AS hi, 0::BIGINT AS k, units, total FROM units
 UNION ALL SELECT doc_id, hi, list_max(list_filter(units, lambda x: x <= hi + 1024)), k + 1, units, total FROM hop WHERE hi < total),
chunk AS (SELECT doc_id, k, lo, hi, min(i) AS line_start, max(i) AS line_end, string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) AS text
 FROM hop JOIN line USING (doc_id) WHERE start >= lo AND start < hi GROUP BY doc_id, k, lo, hi)"""


@query(f"""WITH RECURSIVE {_FILES}, {_CHUNKS} SELECT doc_id, k AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, lo AS byte_start, hi AS byte_end,
 line_start, line_end, sha256(text) AS chunk_sha256 FROM chunk""")
def c04_logical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = source_files(spark, sf_dir).select("*", F.lit("zz").alias("language_id"), F.lit(None).cast("string").alias("grammar"), F.lit("heuristic").alias("detected_by"))
    chunks = S.chunk_sources(known)
    return chunks.select("doc_id", "chunk_index", "total_chunks", "byte_start", "byte_end", "line_start", "line_end", F.sha2("chunk", 256).alias("chunk_sha256"))


@query(f"""WITH RECURSIVE {_FILES}, {_CHUNKS},
near AS (SELECT c.doc_id, c.k, l.start, c.hi FROM chunk c JOIN line l ON l.doc_id = c.doc_id AND l.start >= c.lo AND l.start < c.hi
 QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.k ORDER BY abs(c.hi - l.start - 205), l.start) = 1),
last AS (SELECT near.doc_id, near.k + 1 AS k, string_agg(line || chr(10), '' ORDER BY i) AS overlap FROM near JOIN line ON line.doc_id = near.doc_id AND line.start >= near.start AND line.start < near.hi GROUP BY ALL)
SELECT doc_id, k AS chunk_index, sha256(CASE WHEN overlap IS NULL THEN text ELSE '# ...' || chr(10) || overlap || chr(10) || '# ---' || chr(10) || text END) AS contextualized_sha256,
 strlen(text) + coalesce(strlen(overlap) + 13, 0) AS token_count FROM chunk LEFT JOIN last USING (doc_id, k)""")
def w10_chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks below the last lines of the chunk before, about a fifth of a chunk's size; no other context."""
    known = source_files(spark, sf_dir).select("*", F.lit("zz").alias("language_id"), F.lit(None).cast("string").alias("grammar"), F.lit("heuristic").alias("detected_by"))
    chunks = S.chunk_sources(known, S.Options(context="none"))
    return chunks.select("doc_id", "chunk_index", F.sha2("contextualized", 256).alias("contextualized_sha256"), "token_count")


_KIND = "CASE WHEN list_contains(['class','struct','record','module','namespace','trait','impl','entity','architecture','package','component'], word) THEN 'class' WHEN list_contains(['interface','enum','type','method'], word) THEN word ELSE 'function' END"


@query(f"""WITH {_FILES}, {_LINES}, d AS (SELECT doc_id, start, upto, trim(line, {_BLANKS}) AS signature, lower(regexp_extract(line, '{_DECLARES}', 1)) AS word, regexp_extract(line, '{_DECLARES}', 2) AS name FROM marked WHERE declares)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS number, name, {_KIND} AS kind, left(signature, 240) AS signature, start AS byte_start, upto AS byte_end FROM d""")
def f20_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.file_entities(source_files(spark, sf_dir))


@query("""WITH l AS (SELECT conv_id, turn, text, strlen(text) AS total, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM conversations WHERE text <> ''),
b AS (SELECT *, strlen(line) + (i < n)::INT AS bytes, sum(strlen(line) + (i < n)::INT) OVER (PARTITION BY conv_id, turn ORDER BY i DESC) AS suffix FROM l),
best AS (SELECT conv_id, turn, i FROM b WHERE bytes > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY abs(suffix - 120), i) = 1),
lines AS (SELECT b.conv_id, b.turn, string_agg(line || CASE WHEN b.i < n THEN chr(10) ELSE '' END, '' ORDER BY b.i) AS last FROM b JOIN best ON b.conv_id = best.conv_id AND b.turn = best.turn AND b.i >= best.i GROUP BY ALL),
o AS (SELECT c.conv_id, c.turn, c.role, coalesce(c.text, '') AS text, lag(last) OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS overlap FROM conversations c LEFT JOIN lines USING (conv_id, turn))
SELECT conv_id, turn, strlen(overlap)::BIGINT AS overlap_bytes,
 sha256('# ' || role || chr(10) || chr(10) || coalesce('# ...' || chr(10) || overlap || chr(10) || '# ---' || chr(10), '') || text) AS contextualized_sha256 FROM o""")
def c10_turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of their conversation, each below the last lines of the turn before."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.concat(F.lit("# "), "role").alias("header"))
    out = S.with_overlap(turns, ["conv_id"], "turn", most=400, ratio=0.3)
    return out.select("conv_id", "turn", F.octet_length("overlap").cast("long").alias("overlap_bytes"), F.sha2("contextualized", 256).alias("contextualized_sha256"))


#: Long imports and declarations that belong to the table's own ids make some files overrun their budget.
def _wordy(files: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 16
    imports = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.lit("import module_"), F.md5(F.concat(F.col("path"), i.cast("string"))), F.lit("\n"))), "")
    name = F.concat(F.lit("\ndef "), F.repeat(F.md5("path"), 40), F.lit("\n"))
    more = F.when(k == 1, imports).when(k == 2, F.concat(imports, imports, imports, imports)).when(k == 3, F.concat(F.lit("\n"), F.repeat(name, 8))).otherwise("")
    return files.withColumn("text", F.concat("text", more))


@query()
def c08_fitted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each file was fitted into a budget of 1800 bytes a chunk with its context: held against a plain scan in tests."""
    found = L.detect_sources(_wordy(source_files(spark, sf_dir)))
    chunks = S.chunk_sources(found, S.Options(), budget=1800)
    return chunks.groupBy("doc_id", "strategy", "fallback_reason", "most", "retries", "error").agg(
        F.count("chunk_index").alias("chunks"), F.coalesce(F.max("token_count"), F.lit(0)).alias("largest"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes")
    )


def _detection_sql() -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {', '.join(map(text, r))})" for i, r in enumerate(L.COMMON))
    preferred = ", ".join(f"('{k}', '{v}')" for k, v in L.PREFERRED.items())
    words = "|".join(L.DECLARING)
    return rf"""WITH {_FILES}, f AS (SELECT page_id AS doc_id, path, CASE page_id % 7 WHEN 1 THEN '#!/usr/bin/env python3' || chr(10) WHEN 2 THEN '#!/bin/sh' || chr(10) ELSE '' END || text AS text,
 lower(string_split(path, '/')[-1]) AS base, string_split(path, '/')[-1] AS name FROM pages JOIN files ON page_id = doc_id),
c(o, name, type, grammar, ext, fn, run) AS (VALUES {rows}), p(ext, name) AS (VALUES {preferred}),
e AS (SELECT x.ext, c.name, type, grammar FROM (SELECT o, unnest(string_split(ext, ' ')) AS ext FROM c) x JOIN c USING (o) LEFT JOIN p ON p.ext = x.ext AND p.name = c.name
 WHERE x.ext <> '' QUALIFY row_number() OVER (PARTITION BY x.ext ORDER BY p.name IS NULL, grammar IS NULL, type <> 'programming', c.name) = 1),
n AS (SELECT x.fn, c.name, type, grammar FROM (SELECT o, unnest(string_split(fn, ' ')) AS fn FROM c) x JOIN c USING (o) WHERE x.fn <> '' QUALIFY row_number() OVER (PARTITION BY x.fn ORDER BY grammar IS NULL, type <> 'programming', c.name) = 1),
r AS (SELECT x.run, c.name, type, grammar FROM (SELECT o, unnest(string_split(run, ' ')) AS run FROM c) x JOIN c USING (o) WHERE x.run <> '' QUALIFY row_number() OVER (PARTITION BY x.run ORDER BY o) = 1),
told AS (SELECT doc_id, 2 AS how, 0 AS w, n.name, type, grammar FROM f JOIN n ON base = fn UNION ALL SELECT doc_id, 3, 0, c.name, type, grammar FROM f JOIN c ON c.name = 'Dockerfile' AND starts_with(base, 'dockerfile')
 UNION ALL SELECT doc_id, 4, -length(ext), e.name, type, grammar FROM f JOIN e ON ends_with(base, ext)
 UNION ALL SELECT doc_id, 5, 0, r.name, type, grammar FROM f JOIN r ON lower(regexp_extract(text, '^#!\s*(?:/usr/bin/env\s+)?([^\s/]+)(?:\s|$)', 1)) = run),
first AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY how, w) = 1),
head AS (SELECT *, list_slice(string_split_regex(text, '\r?\n'), 1, 200) AS h, regexp_matches(lower(path), '\.(md|mdx|rst|txt|adoc|asciidoc)$') AS prose, regexp_matches(base, '^(readme|license|licence|changelog|contributing|authors|notice)(\.|$)') AS bare FROM f),
signs AS (SELECT doc_id, (len(list_filter(h, lambda x: regexp_matches(x, '(?i)^\s*(?:(?:pub|public|private|protected|static|async|export|abstract|final|open|internal)\s+)*({words})\s+[A-Za-z_$]'))) > 0)::INT
 + (len(list_filter(h, lambda x: regexp_matches(x, '(?i)^\s*(?:import|include|require|use|using|from|with)\b'))) > 0)::INT
 + (regexp_matches(text, '(?s)[({{].*[)}}]') AND regexp_matches(text, '[;:=]'))::INT + regexp_matches(text, '^#!\s*/')::INT AS signs FROM head),
g AS (SELECT head.doc_id, prose, bare, signs, first.name, first.type, first.grammar, first.how, CASE WHEN contains(head.name, '.') THEN string_split(head.name, '.')[-1] ELSE 'source' END AS ending FROM head JOIN signs USING (doc_id) LEFT JOIN first ON first.doc_id = head.doc_id AND NOT prose AND NOT bare),
i AS (SELECT *, regexp_replace(regexp_replace(replace(replace(lower(coalesce(name, ending)), '++', 'pp'), '#', 'sharp'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS id FROM g)
SELECT doc_id, CASE WHEN name IS NOT NULL THEN CASE name WHEN 'Shell' THEN 'bash' ELSE id END WHEN signs >= 2 AND NOT prose THEN coalesce(nullif(id, ''), 'source') ELSE 'text' END AS language_id,
 coalesce(type, CASE WHEN signs >= 2 AND NOT prose THEN 'programming' ELSE 'text' END) AS language_type, grammar,
 CASE WHEN how IN (2, 3) THEN 'filename' WHEN how = 4 THEN 'extension' WHEN how = 5 THEN 'shebang' WHEN signs >= 2 AND NOT prose THEN 'heuristic' ELSE 'plain-text' END AS detected_by FROM i"""


@query(_detection_sql())
def f18_detected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have a document: its file, some with a first line that names an interpreter."""
    k = F.col("doc_id") % 7
    first = F.when(k == 1, "#!/usr/bin/env python3\n").when(k == 2, "#!/bin/sh\n").otherwise("")
    files = source_files(spark, sf_dir).join(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), "doc_id").withColumn("text", F.concat(first, "text"))
    return L.detect_sources(files).select("doc_id", "language_id", "language_type", "grammar", "detected_by")


# Retrieval within a question's own corpus, with real chunks and their lines: a file's first declaration is the target,
# its signature the question, the files of its source the corpus.


@query(f"""WITH RECURSIVE {_FILES}, {_CHUNKS},
d AS (SELECT doc_id AS item_id, i, trim(line, {_BLANKS}) AS question FROM marked WHERE declares QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1),
src AS (SELECT doc_id, source FROM documents),
asked AS (SELECT source, item_id, term, count(*) AS q FROM (SELECT item_id, lower(unnest(regexp_extract_all(left(question, 240), '[A-Za-z0-9_]+'))) AS term FROM d) JOIN src ON doc_id = item_id GROUP BY ALL),
tok AS (SELECT source, doc_id * 100000 + k AS id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t, list_transform(regexp_extract_all(path, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS m
 FROM chunk JOIN src USING (doc_id) JOIN (SELECT doc_id, path FROM files) USING (doc_id)),
lens AS (SELECT source, id, len(t) + 2.0 * len(m) AS dl FROM tok), stats AS (SELECT source, count(*) AS n, avg(dl) AS al FROM lens GROUP BY source),
tf AS (SELECT source, id, term, sum(w)::DOUBLE AS tf FROM (SELECT source, id, unnest(t) AS term, 1.0 AS w FROM tok UNION ALL SELECT source, id, unnest(m), 2.0 FROM tok) GROUP BY ALL),
dfs AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
kw AS (SELECT item_id, id, round(sum(q * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(al, 1.0)))), 6) AS score
 FROM asked JOIN tf USING (source, term) JOIN dfs USING (source, term) JOIN lens USING (source, id) JOIN stats USING (source) GROUP BY ALL HAVING score > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM kw QUALIFY rank <= 32)
SELECT d.item_id, min(rank) AS target_rank, round(coalesce(1.0 / min(rank), 0.0), 6) AS reciprocal_rank
FROM d LEFT JOIN (SELECT ranked.*, doc_id, line_start, line_end FROM ranked JOIN chunk ON id = doc_id * 100000 + k) r ON r.item_id = d.item_id AND r.doc_id = d.item_id AND line_start <= i AND line_end >= i GROUP BY d.item_id""")
def j15_target_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = S.target_chunks(source_files(spark, sf_dir, "source"), ["source"])
    place = F.col("doc_id") * 100000 + F.col("chunk_index")
    target = F.when(F.col("asked").isNotNull(), F.col("doc_id"))
    corpus = chunks.select("source", place.alias("doc_id"), "text", F.col("path").alias("meta"), target.alias("item_id"), "asked", F.when(F.col("path").isNotNull(), place).alias("goal"))
    blocks = stored(Q.term_blocks(corpus, ["source"]))
    asked = blocks.select(F.get_json_object("corpus", "$.source").alias("source"), F.explode("asked").alias("a"))
    questions = asked.select("source", "a.item_id", "a.text")
    return Q.goal_ranks(blocks, questions, asked.select("source", "a.item_id", F.col("a.goal").alias("doc_id")), ["source"])


def _conversation_corpora(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy((F.col("role") != "user").asc(), "turn"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", nth.alias("nth"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = turns.where("nth = 1").withColumn("vec_id", F.col("conv_id") % 41).join(vectors, "vec_id")
    rest = turns.where("nth > 1").withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn")) % 41).join(vectors, "vec_id")
    chunks = rest.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.col("role").alias("meta"), F.col("embedding").alias("vec"), (F.col("turn") % 3).cast("long").alias("quality"))
    questions = asked.select("conv_id", F.col("conv_id").alias("item_id"), "text", F.col("embedding").alias("qvec"))
    return chunks, questions


_TURNS = """base AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'user', turn) AS nth FROM conversations),
q AS (SELECT conv_id, text, embedding AS qvec FROM base JOIN embeddings ON vec_id = conv_id % 41 WHERE nth = 1),
c AS (SELECT conv_id, conv_id * 1000 + turn AS doc_id, text, role AS meta, (turn % 3)::BIGINT AS quality, embedding AS vec FROM base JOIN embeddings ON vec_id = (conv_id * 7 + turn) % 41 WHERE nth > 1)"""


@query(rf"""WITH {_TURNS},
tok AS (SELECT conv_id, doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t, list_transform(regexp_extract_all(meta, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS m FROM c),
lens AS (SELECT conv_id, doc_id, len(t) + 2.0 * len(m) AS dl FROM tok), stats AS (SELECT conv_id, count(*) AS n, avg(dl) AS al FROM lens GROUP BY conv_id),
tf AS (SELECT conv_id, doc_id, term, sum(w)::DOUBLE AS tf FROM (SELECT conv_id, doc_id, unnest(t) AS term, 1.0 AS w FROM tok UNION ALL SELECT conv_id, doc_id, unnest(m), 2.0 FROM tok) GROUP BY ALL),
dfs AS (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY ALL),
asked AS (SELECT conv_id, term, count(*) AS q FROM (SELECT conv_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM q) GROUP BY ALL),
kw AS (SELECT conv_id, doc_id, round(sum(q * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(al, 1.0)))), 6) AS score
 FROM asked JOIN tf USING (conv_id, term) JOIN dfs USING (conv_id, term) JOIN lens USING (conv_id, doc_id) JOIN stats USING (conv_id) GROUP BY ALL HAVING score > 0),
ch AS (SELECT conv_id, doc_id, score, quality FROM kw JOIN c USING (conv_id, doc_id)), ds AS (SELECT conv_id, doc_id, round(list_cosine_similarity(qvec::DOUBLE[], vec::DOUBLE[]), 6) AS score, quality FROM q JOIN c USING (conv_id)),
r AS (SELECT conv_id, doc_id, quality, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, quality DESC, doc_id) AS rank FROM ch QUALIFY rank <= 32 UNION ALL
 SELECT conv_id, doc_id, quality, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, quality DESC, doc_id) AS rank FROM ds QUALIFY rank <= 32),
f AS (SELECT conv_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, max(quality) AS quality, min(rank) AS best FROM r GROUP BY ALL),
pool AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, quality DESC, best, doc_id) AS rank FROM f QUALIFY rank <= 20),
w AS (SELECT pool.*, list_distinct(list_filter(regexp_split_to_array(lower(q.text), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(meta || chr(10) || c.text), '\s+'), lambda x: x <> '')) AS b
 FROM pool JOIN q USING (conv_id) JOIN c USING (conv_id, doc_id)),
s AS (SELECT *, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) AS rerank FROM w), h AS (SELECT *, max(rerank) OVER (PARTITION BY conv_id) AS top FROM s)
SELECT conv_id, doc_id, rank, quality, rerank, row_number() OVER (PARTITION BY conv_id ORDER BY rerank DESC, quality DESC, rank) AS number FROM h WHERE rerank >= greatest(0.00017189, top * 0.855) QUALIFY number <= 5""")
def r13_corpus_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a corpus of its turns; its first user turn asks."""
    chunks, questions = _conversation_corpora(spark, sf_dir)
    return Q.hybrid_within(chunks, questions, ["conv_id"]).drop("item_id")


# What chunks are embedded with, and which declarations they hold.


@query(f"""WITH RECURSIVE {_FILES}, {_CHUNKS}, d AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS number, start, upto, regexp_extract(line, '{_DECLARES}', 2) AS name FROM marked WHERE declares)
SELECT d.doc_id, k AS chunk_index, number, name, upto > hi AS partial FROM d JOIN chunk ON chunk.doc_id = d.doc_id AND start >= lo AND start < hi""")
def j25_chunk_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(source_files(spark, sf_dir))
    known = files.select("*", F.lit("zz").alias("language_id"), F.lit(None).cast("string").alias("grammar"), F.lit("heuristic").alias("detected_by"))
    return P.chunk_entities(S.chunk_sources(known), S.file_entities(files)).select("doc_id", "chunk_index", "number", "name", "partial")


@query(f"""WITH RECURSIVE {_FILES}, {_CHUNKS} SELECT doc_id || ':' || k AS id, path, k AS chunk_index, sha256(text) AS content_hash, strlen(text) AS text_bytes, 'model-a' AS model_id, 64 AS dimension,
 [length(text)::DOUBLE, 0.0, 1.0, 0.0] AS vector, sha256(json_object('path', path, 'language', 'zz', 'context', {{'line_start': line_start, 'line_end': line_end}})::VARCHAR) AS searchable_sha256
FROM chunk JOIN (SELECT doc_id, path FROM files) USING (doc_id)""")
def s06_embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all files as records of a vector store, with what keyword search reads beside them."""
    files = source_files(spark, sf_dir)
    known = files.select("*", F.lit("zz").alias("language_id"), F.lit(None).cast("string").alias("grammar"), F.lit("heuristic").alias("detected_by"))
    chunks = S.chunk_sources(known).join(files.select("doc_id", "path"), "doc_id")
    where = F.struct("line_start", "line_end")
    inputs = chunks.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), F.col("chunk").alias("text"), "path", "chunk_index", P.searchable(F.col("path"), F.lit("zz"), where).alias("searchable"))
    records = P.vector_records(inputs, "model-a", 64)
    p = F.col("payload")
    return records.select("id", p["path"].alias("path"), p["chunk_index"].alias("chunk_index"), "content_hash", F.octet_length(p["text"]).cast("long").alias("text_bytes"), p["model_id"].alias("model_id"), p["dimension"].alias("dimension"), P.mock_embedding(p["text"], 4).alias("vector"), F.sha2(p["searchable"], 256).alias("searchable_sha256"))


_IMPORTS = rf"(?i)^{_WS}*(?:{'|'.join(L.IMPORTING)})\b"


@query(rf"""WITH {_FILES}, {_LINES}, im AS (SELECT doc_id, start, coalesce(nullif(regexp_extract(trim(line, {_BLANKS}), '["''<]([^"''>]+)["''>]', 1), ''), left(trim(line, {_BLANKS}), 120)) AS name FROM line WHERE regexp_matches(line, '{_IMPORTS}')),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_extract(line, '{_DECLARES}', 2) || ' ' || left(trim(line, {_BLANKS}), 240), '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM marked WHERE declares)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS number, name, w.name IS NOT NULL AS used FROM im LEFT JOIN w USING (doc_id, name)""")
def j24_marked_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(source_files(spark, sf_dir))
    return S.marked_imports(S.file_imports(files), S.file_entities(files))


@query(f"""WITH {_FILES}, {_LINES}, d AS (SELECT doc_id, start AS byte_start, upto AS byte_end, lower(regexp_extract(line, '{_DECLARES}', 1)) AS word, regexp_extract(line, '{_DECLARES}', 2) AS name FROM marked WHERE declares),
k AS (SELECT doc_id, byte_start, byte_end, name, {_KIND} AS kind FROM d)
SELECT doc_id, byte_start, byte_end, kind, CASE WHEN byte_start % 2 = 0 THEN 'tagged' ELSE 'walked' END AS origin FROM k""")
def j23_united_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that two finders tell: one has those at even places, the other all."""
    known = stored(S.file_entities(source_files(spark, sf_dir)).select("doc_id", "byte_start", "byte_end", "kind"))
    tagged = known.where("byte_start % 2 = 0").withColumn("origin", F.lit("tagged"))
    return S.united_entities(tagged, known.withColumn("origin", F.lit("walked")))


_R13 = ORACLES["r13_corpus_retrieval"]


@query(rf"""{_R13[: _R13.rindex("SELECT conv_id, doc_id, rank")].rstrip()},
hits AS ({_R13[_R13.rindex("SELECT conv_id, doc_id, rank"):]}),
g AS (SELECT conv_id, doc_id, meta = 'assistant' AS gold, hits.number IS NOT NULL AS got FROM c JOIN (SELECT conv_id FROM q) USING (conv_id) LEFT JOIN hits USING (conv_id, doc_id)),
n AS (SELECT conv_id, count(*) FILTER (gold AND got) AS tp, count(*) FILTER (NOT gold AND got) AS fp, count(*) FILTER (gold AND NOT got) AS fn, count(*) FILTER (NOT gold AND NOT got) AS tn FROM g GROUP BY conv_id)
SELECT conv_id, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM n""")
def r14_example_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each example's question found the assistant's turns among its own corpus."""
    chunks, questions = _conversation_corpora(spark, sf_dir)
    gold = chunks.select("conv_id", "doc_id", (F.col("meta") == "assistant").cast("int").alias("gold"))
    return E.example_relevance(gold, Q.hybrid_within(chunks, questions, ["conv_id"]), questions, ["conv_id"])


@query(rf"""{_R13[: _R13.rindex("SELECT conv_id, doc_id, rank")].rstrip()},
hits AS ({_R13[_R13.rindex("SELECT conv_id, doc_id, rank"):]}),
p AS (SELECT conv_id, number, '// Path: ' || meta || ' (lines ' || doc_id % 1000 || '-?)' || chr(10) || text AS piece FROM hits JOIN c USING (conv_id, doc_id)),
l AS (SELECT *, 1500 - coalesce(sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM p)
SELECT conv_id AS item_id, count(*) AS pieces, sha256(string_agg(left(piece, room::BIGINT), chr(10) || chr(10) ORDER BY number)) AS context_sha256 FROM l WHERE room > 0 GROUP BY conv_id""")
def w05_retrieval_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, questions = _conversation_corpora(spark, sf_dir)
    hits = Q.hybrid_within(chunks, questions, ["conv_id"]).join(chunks.select("doc_id", "text", F.col("meta").alias("path")), "doc_id")
    ranked = hits.select("item_id", "number", "path", (F.col("doc_id") % 1000).alias("start_line"), F.lit(None).cast("long").alias("end_line"), "text")
    return P.retrieval_contexts(ranked, 1500).select("item_id", "pieces", F.sha2("context", 256).alias("context_sha256"))
