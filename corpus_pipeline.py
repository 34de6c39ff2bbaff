"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet below the checkpoint folder and hands what it reads back to the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm.codec import digests, encode_decode
from netsift.llm.common import fold, table, unused
from netsift.llm.mixing import mixed
from netsift.llm.ngram_join import one_of_each
from netsift.llm.pii import pseudonymise, secret
from netsift.llm.toxicity import docs_with_scores, train
from netsift.plans.lineage import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models reject go.  Labels come from the training fold of the labels table.

    Null, empty and wordless texts have no evidence and stay; repeated rows are judged
    alike; columns of any name stay; an empty table stays empty.
    """
    judge = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    score, toxic = unused(docs, "score"), unused(docs, "toxic")
    return docs_with_scores(docs, "text", judge, score, toxic).where(F.col(toxic) == 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group stays: five words, similarity of 0.8 or more.

    Rows are told apart by id and text: different texts of one id, or of none, are
    documents of their own.  Null, empty and wordless texts all stay.
    """
    return one_of_each(docs, n=5, num=80, den=100)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms of its format, under the session's key; n_chars follows the text.

    Null texts stay null with n_chars 0, and every row stays, repeated ones too.
    """
    columns = docs.columns
    changed = pseudonymise(docs, secret(spark))
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return changed.select(*columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources to their target weights takes it: no time to three times.

    A null source is a source of its own, the last; a null text has no words.
    """
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256): a row of token ids for each row of the mix; none for a null or empty text."""
    encoded = encode_decode(docs.select(F.struct("doc_id", "source").alias("__key"), "text"), id_col="__key")
    return encoded.select("doc_id.*", "ids", "decoded").withColumns(digests()).drop("decoded")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("pii", pii),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL cannot express the models of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table, each written and read again; what the next has read is deleted."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, f"{folder}/{before}")
        before = name
    return docs
