"""The corpus pipeline: five stages over `documents`, each written and read again before the next.

Every stage but the last returns the columns of `documents`; `n_chars` follows the text where a stage changes it.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bunkerline.llm import line_crf, mixing, ngram_join, packing, suffix_dedup
from bunkerline.llm.common import store
from bunkerline.llm.queries import mixture, quality_model, word_vocabulary
from bunkerline.session import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents below this quality go; the classifier's own threshold for a good one is higher, so that doubtful ones stay.
LEAST_QUALITY = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model does not reject."""
    scored = line_crf.score(docs, quality_model(spark, docs, sf_dir), keep=tuple(COLUMNS), lines=False)
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one of the least id.

    Of rows that repeat entirely one stays; rows without an id stay.
    """
    found = ngram_join.join_texts(docs, 5, Fraction(4, 5))
    stays = found.where(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias("stays")).distinct()
    named = docs.select(*COLUMNS).join(stays, F.col("doc_id") == F.col("stays")).select(*COLUMNS)
    # texts move once: the rows of an id are in one task by now, where those that repeat stand together
    again = F.row_number().over(Window.partitionBy(*COLUMNS).orderBy("doc_id"))
    once = named.withColumn("_again", again).where("_again = 1").select(*COLUMNS)
    return once.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 400 that also start elsewhere; characters stay whole."""
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), whole_characters=True)
    less, text = F.size("spans") > 0, F.col("kept").cast("string")
    return cut.select("doc_id", F.when(less, text).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(less, F.char_length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their sources' targets: none, one or two rows of each."""
    key = F.xxhash64("text")
    sized = store(docs.select("doc_id", "source", key.alias("key"), mixing.words(F.col("text")).alias("size")))
    _, targets = mixture(sized)
    taken = mixing.mix(sized, F.col("size"), F.array("source"), targets)
    copies = taken.groupBy("doc_id", "key").agg(F.max(F.size("takes")).alias("copies")).where("copies > 0")
    copies = copies.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "copies")
    joined = docs.select(*COLUMNS).join(copies, F.col("doc_id").eqNullSafe(F.col("id")) & (key == F.col("k")))
    return joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of every document stands in the packed sequences."""
    pieces = packing.tokenise(docs, word_vocabulary())
    return packing.place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", join_near),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: No SQL can state the classifier, so the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
