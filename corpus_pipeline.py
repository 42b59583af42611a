"""The corpus pipeline: documents through the stages in STAGES, each written as Parquet
and read again as the next one's documents.

A stage begins with the memory that the executors can spare given back (``free_heaps``).
All stages but the last return the columns of documents (``n_chars`` follows ``text``):

1. toxicity: documents scored as toxic go;
2. lines: boilerplate lines go out of the texts that have others;
3. near_dups: of each class of near-duplicates the document with the smallest id stays;
4. repeats: passages of over 50 words that repeat go out of the texts: spans of repeated
   strings of PASSAGE_BYTES bytes with PASSAGE_WORDS words or more.  As in the operator every
   copy goes, the first one too (what is left of cut characters also), so a document of nothing
   but such passages becomes empty;
5. packing: the texts are packed into sequences of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import lines, near_dups, packing, repeats, toxicity
from pathloom.llm.common import free_heaps, new_path, original


#: Words from which a repeated passage goes, and bytes of the strings that it is made of (so
#: many words have more, even words of two letters).
PASSAGE_WORDS = 51
PASSAGE_BYTES = 150


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_heaps(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs, labels)
    return original(toxicity.score(docs, model).where(F.col("__score") < toxicity.THRESHOLD), docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_heaps(spark)
    return _counted(original(lines.remove_boilerplate(docs), docs.columns))


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_heaps(spark)
    return near_dups.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_heaps(spark)
    out = repeats.remove_repeats(docs, length=PASSAGE_BYTES, words=PASSAGE_WORDS).withColumn("text", F.col("__text"))
    return _counted(original(out, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_heaps(spark)
    return packing.pack_documents(docs.select("doc_id", "text"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", toxicity_stage),
    ("lines", lines_stage),
    ("near_dups", near_dups_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]
#: Its stages are not all expressible in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
