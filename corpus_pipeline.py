"""The cleaning pipeline over ``documents``: five stages, each one of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return
the columns of ``documents``; the last returns the packed pieces.

Defined results of every stage but the last: rows with nulls in any column are judged like others (a null text is an empty one, which is
neither toxic, nor like another, nor contaminated, nor holds a secret) and stay, with their nulls; very long texts are judged whole; an empty table
stays empty; further columns stay, whatever their names.  Repeated rows and copies: near-duplicate removal keeps one row of a text, all other stages treat each row alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, neardup, packing, secrets, toxicity
from quillspark.llm.common import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar predicts to be toxic go; without labels its fixed words alone decide."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least id; of ties, the text of the least hash, once.  Texts without words stay."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark text in them go; without benchmark items all stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are written as [SECRET]; no document goes."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents packed into sequences; a null text is a piece of the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

# The tokenizer's ids, the sketches and the learned grammar can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
