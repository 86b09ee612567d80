"""A training corpus from documents: language, near-duplicates, secrets, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.llm import langid, secrets, simhash
from touchline.llm.common import materialise
from touchline.llm.mixing import mixed
from touchline.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, with lang as predicted; the others (null and empty texts too) go.

    Where no row has a label to learn from, lang stays as it is. Null ids, ties and repeated rows: each by its own text.
    Empty table: no rows. All columns are carried, whatever their names.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    names = docs.columns
    own = {n: f"c{i}" for i, n in enumerate(names)}
    found = langid.identify(docs.toDF(*own.values()), model, text_col=own["text"])
    known = F.col("lang_pred") != langid.UNKNOWN
    kept = found.where(known | F.coalesce(F.col(own["text"]).rlike(langid.LETTER), F.lit(False)))
    return kept.withColumn(own["lang"], F.when(known, F.col("lang_pred")).otherwise(F.col(own["lang"]))).select(*own.values()).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the rows of its least id, so repeated rows of that id stay; rows of null id stay too.

    Null and empty texts are copies of each other. Empty table: no rows. All columns are carried, whatever their names.
    """
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets masked; n_chars follows the text, and stays for a null one.

    Empty texts, ties and repeated rows stay. Empty table: no rows. All columns are carried, whatever their names.
    """
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them; those without words never.

    Null source: a source of its own. Null ids and repeated rows: each decided by itself. Empty table: no rows. All columns are carried, whatever their names.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; row tells repetitions of a document apart.

    Null and empty texts: one end token. Null ids and repeated rows: packed each. Empty table: no rows. Other columns are not carried.
    """
    return pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
    ("packing", packing),
]

#: Language scores, SimHash components and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
