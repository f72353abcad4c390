"""A corpus pipeline over `documents`: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulore.llm import language_id
from tabulore.llm.common import cut, is_held_out, shared_dir, table
from tabulore.llm.exact_dedup import drop_copies
from tabulore.llm.mixing import mix
from tabulore.llm.near_copies import drop_near
from tabulore.llm.packing import pack
from tabulore.llm.queries import TOKENIZER

LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no determined language, or of one that is less likely than not, go; lang becomes the predicted one."""
    model = language_id.train(docs.filter(~is_held_out(F.col("doc_id"))))
    said = language_id.language_id(docs, model).filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return said.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a Jaccard similarity of 0.8 or more, by five-word shingles, one row stays."""
    return drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it. Rows are told apart by id and text; those that repeat both share what is taken of them."""
    key = F.md5(F.to_json(F.struct("doc_id", "text"), {"ignoreNullFields": "false"}))
    mixed = mix(docs.select(key.alias("_key"), "text", "source"), id_col="_key").groupBy("_key").agg(F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
    mixed = cut(mixed)
    rows = docs.withColumn("_own", key).join(mixed, F.col("_own") == F.col("_key"))
    repeated = not mixed.filter("_rows > 1").isEmpty()
    at = F.row_number().over(Window.partitionBy("_own").orderBy(F.lit(0))) if repeated else F.lit(1)
    rows = rows.withColumn("_at", at)
    copies = F.floor(F.col("_sum") / F.col("_rows")) + (F.col("_at") <= F.col("_sum") % F.col("_rows")).cast("int")
    taken = rows.withColumn("_n", copies.cast("int")).filter("_n > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return pack(docs.select("doc_id", "text"), TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can express neither the learned model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each but the last written to the shared folder and read again. What a
    stage has read goes when its result is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
