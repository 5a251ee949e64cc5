"""Training-corpus pipeline: quality classifier, near-dedup, repeat removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, kneserney, packing, setsketch, suffixdedup
from corpusloom.llm.common import discard, materialize
from corpusloom.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit.

    Null and empty texts stay; rows that share an id are judged by their own texts; a null lang has the limit of other
    languages; without trusted documents, and with an empty table, nothing goes.
    """
    model = kneserney.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kneserney.classify(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest id.

    Rows that are equal in id and text stay once, the one with the least lang, source and n_chars. Null, empty and
    blank texts are no one's duplicates; a row without an id stays only where no row of its group has one.
    """
    kept = setsketch.near_duplicates(docs, size=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    left = docs.select(*COLUMNS).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")), "left_semi")
    # Rows of one id and text meet by a hash of the text, so no text is compared or dealt by its bytes.
    same = Window.partitionBy("doc_id", F.xxhash64("text"), F.sha2("text", 256)).orderBy("lang", "source", "n_chars")
    return left.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 50-byte strings that a document with a smaller id has. Texts left empty go.

    Of a character that a string cuts in two nothing is left; all other characters, U+FFFD too, are kept as they are.
    Null texts count as empty and stay as empty ones; rows with a null id or a shared one lose nothing to each other.
    """
    out = suffixdedup.remove_repeats(docs, 50, ("lang", "source"), characters=True)
    out = out.where("n_removed = 0 or octet_length(kept) > 0").withColumn("text", F.col("kept").cast("string"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor an edited copy of one.

    Rows that share an id go together; null and empty texts stay; without items nothing goes.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full token sequences.

    Null and empty texts give their end id; repeated rows are packed as often as they stand; an empty table gives none.
    """
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), 1, 2048, added=True)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Language models, alignments and tokenizers are beyond SQL; tests hold each stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            discard(before)  # its successor is written
    return docs
