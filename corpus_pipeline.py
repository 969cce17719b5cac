"""A corpus from documents to packed sequences; every stage works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash, packing, repeats, secrets, toxicity
from tessera.llm.scratch import keep

#: Words of a shingle, and the similarity in percent from which documents are near-duplicates.
WORDS, PERCENT = 5, 80


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; it learns from those that came in and are labelled.

    Null and empty texts stay, texts of any length are scored whole, repeated rows go or stay together, ties are no question; no
    rows give no rows; all columns pass as they are.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of least id, rows without an id last, and of equal ones the first read.

    Null and empty texts are linked with nothing and stay, texts of any length are taken whole; no rows give no rows; all columns
    pass as they are, and the key has a name that none of them has.
    """
    key = "key_" + "_" * max(map(len, docs.columns))  # longer than any name that is there
    rows = keep(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = keep(minhash.near_duplicates(rows, WORDS, PERCENT, id_col=key).select(F.col("doc_id").alias(key), "component_id"), "components")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key")).alias("place")
    least = found.join(rows.select(key, place).hint("shuffle_hash"), key).groupBy("component_id").agg(F.min("place").alias("place"))
    gone = keep(found.join(least.select(F.col("place.key").alias(key)).hint("shuffle_hash"), key, "left_anti").select(key), "gone")
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document, or the same one before, has are cut from the texts; no document goes.

    A row without an id comes after ids under 2 ** 62, by a digest of its text. Null texts stay null, texts of any length are taken
    whole, rows of an equal id and text are cut alike; no rows give no rows; all columns pass, under whatever names.
    """
    kept_id = "id_" + "_" * max(map(len, docs.columns))
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    keyed = docs.withColumn(kept_id, F.col("doc_id")).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), late))
    return repeats.without_repeats(keyed).withColumn("doc_id", F.col(kept_id)).select(*docs.columns)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes.

    Null texts stay null, texts of any length are scanned whole, repeated rows alike; no rows give no rows; other columns pass.
    """
    return secrets.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts and their places in sequences.

    A null text is an end id alone, texts of any length are cut whole, repeated rows and those without an id are packed too, ties
    as they come; no rows give no rows; further columns are ignored.
    """
    return packing.pack_documents(docs, added=True)


STAGES = [("toxicity", toxic), ("near-duplicates", near), ("repeats", repeated), ("secrets", secret), ("packing", packed)]

#: SQL can express neither the network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
