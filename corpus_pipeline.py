"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import place, scratch, table
from larkspan.llm.fuzzy_lines import dedup_lines
from larkspan.llm.minhash import drop_near_duplicates
from larkspan.llm.packing import pack
from larkspan.llm.pii import mask
from larkspan.llm.quality import POLICIES, PRODUCTION, accepted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps.

    A null or empty text has no words and goes; rows are judged one by one, so repeated rows and ties stay or go
    together; rows that stay are unchanged in all columns, whatever their names; an empty table gives an empty one.
    """
    return accepted(docs, POLICIES[PRODUCTION])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stay elsewhere, with n_chars (if there is one) counted anew; documents that lose all their words go.

    Null and empty texts stay as they are.  Of equal or near-equal lines the one of the smallest key (null first), then the first
    line, stays; rows equal in key and text keep the same lines.  Other columns stay, whatever their names; an empty table gives an empty one.
    """
    names = docs.columns
    lines = dedup_lines(docs)
    plain = lines.toDF(*[f"_{i}" for i in range(len(names))], "n_lines", "n_dropped")
    text, chars = f"_{place(names, 'text')}", f"_{place(names, 'n_chars')}" if "n_chars" in [n.lower() for n in names] else None
    left = plain.filter((F.col("n_dropped") == 0) | F.col(text).rlike(r"[^\s]"))
    if chars:
        fresh = F.when(F.col("n_dropped") > 0, F.length(text)).otherwise(F.col(chars))
        left = left.withColumn(chars, fresh.cast(plain.schema[chars].dataType))
    return left.drop("n_lines", "n_dropped").toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are alike to 0.8 or more: that of the smallest key.

    Texts without words (null, empty, blank) are linked with nothing and all stay, but for repeated rows; fewer than five words
    are one shingle; a null key never wins over others; of rows equal in key and text one stays.  Other columns stay, whatever
    their names; an empty table gives an empty one.
    """
    return drop_near_duplicates(docs, size=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, and n_chars (if there is one) counted anew; every row stays.

    A null text stays null and an empty one empty; rows equal in key and text get equal texts.  Other columns stay, whatever
    their names; an empty table gives an empty one.
    """
    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids and their sequences.

    A null or empty text is the separator alone; repeated rows are packed each by itself; columns besides doc_id
    and text are left behind, whatever their names; an empty table gives no pieces.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: the tokenizer, the line links and the pattern bootstrap are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None
