"""Documents shaped as source files: linear patterns, and entities that are found once."""

import random
import re
import time

from pyspark.sql import functions as F

from corpusloom import files
from corpusloom.functions import languages as L
from corpusloom.functions import text as T


def test_lines_are_shaped_in_linear_time(spark):
    """The Java patterns give what the SQL's patterns do; a line just too short to be cut costs no square of its length."""
    rng = random.Random(11)
    parts = ["Abc de", "Be", "S x", "Io y ", "Oo ", "\n", ". ", "é", "\r", " ", "x" * 239, "y" * 240, "z" * 700, " ", "E F", "A b. C d", "{"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400)] + ["", "a" * 480, "a" * 240 + "\n" + "b" * 241]
    for text, (got,) in zip(texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1).orderBy("i").select(files._shaped(F.col("t"))).collect(), strict=True):
        for pattern, put in files.SHAPED:
            text = re.sub(pattern, put, text)
        assert got == text
    assert all(put.count("$") == len(re.findall(r"\((?!\?)", pattern)) for pattern, put in files._LINEAR)
    long = spark.range(1).select(F.repeat(F.concat(F.repeat(F.lit("q"), 238), F.lit("\n")), 30_000).alias("t"))
    began = time.perf_counter()
    assert long.select(F.length(files._shaped(F.col("t")))).first()[0] == 239 * 30_000
    assert time.perf_counter() - began < 5


def test_entities_are_found_once(spark):
    plan = files.j23_united_entities(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Scan parquet" not in plan  # both sides read what was stored
    plan = files.j24_marked_imports(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and "regexp_replace" not in plan


def test_signs_of_code_in_linear_time(spark):
    """Openings without a closing one behind them, and more lines than are looked at."""
    rows = [("a(b)=", 1), ("}({;", 0), ("})x(;", 0), ("({;\n}", 1), ("x\n" * 200 + "import y", 0), ("x\r\n" * 199 + "import y", 1), ("", 0)]
    got = spark.createDataFrame(rows, "t string, want int").select(L.code_signs(F.col("t")).alias("n"), "want").collect()
    assert all(r.n == r.want for r in got)
    began = time.perf_counter()
    assert spark.range(1).select(L.code_signs(F.repeat(F.lit(";("), 100_000)).alias("n")).first().n == 0
    assert time.perf_counter() - began < 10


def test_problems_of_content_are_found_without_splitting_all(spark):
    """Blank texts of any white space, marks in the sixth line but not in the seventh, lines too long in long texts only."""
    blank = [chr(c) for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2007, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    odd = ["​", "﻿", "᠎", "\x1c", "\0", "a", "\U0001f600"]
    rows = [(x, "empty_file") for x in ["", "\n", "\r\n", " \n \r\n", *blank, "".join(blank), *(f"\n{b}\n" for b in blank)]]
    rows += [(b + x + b, None) for x in odd for b in ("", "\n", " ", " ")] + [("\x1c\n", None)]
    rows += [("x\r\n" * 5 + "Do Not Edit", "generated_file"), ("x\n" * 6 + "do not edit", None), ("code\ngenerated", None), ("\n" * 5 + "@GENERATED\n" + "x\n" * 99, "generated_file")]
    rows += [("x" * 20001, "minified_file"), ("x" * 20000, None), (("x" * 9999 + "\n") * 3, None), ("a\n" * 5001 + "x" * 10001, "minified_file")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, t string, want string")
    problem = T.content_problem(F.col("t"))
    assert d.where(~problem.eqNullSafe(F.col("want"))).collect() == []
    assert d.where(F.col("t").rlike(r"(?U)^\s*$") != (F.coalesce(problem, F.lit("")) == "empty_file")).collect() == []
