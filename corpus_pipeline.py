"""The corpus pipeline: quality, near-duplicates, secrets, mix and packing, each stage over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage's
result is written as Parquet to the shared folder and read again as the next one's documents.

Defined results: rows with a null doc_id are dropped by the near-duplicate stage; rows that repeat an id and its text are one
from there on, until the mix takes a document several times, while different texts under one id are documents of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import minhash, mixing, nbsvm, packing, secrets
from lodestone.llm.common import Stages, broadcast_if_small, table
from lodestone.llm.queries import QUALITY_BOUND, domain_labels, public_vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What stands for a secret.
REDACTED = "[SECRET]"
#: Shares of all words after the quality stage.
TARGETS = {"clean": 0.95, "toxic": 0.05}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored from the bias alone, repeated rows each by themselves; ids may be null; equal scores are
    decided alike. Without labels of both kinds every document has the same score.
    """
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"))
    return nbsvm.score(docs, model, keep=list(COLUMNS[1:])).where(F.col("score") >= QUALITY_BOUND).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id, of texts with one id the one with the least hash.

    Null and empty texts are classes of their own; rows without an id go; rows of one id and text are one, with the least of
    the other columns; different texts under one id all stay unless another text of their class does.
    """
    stages = Stages(spark)
    docs = docs.where("doc_id is not null").select(*COLUMNS)
    repeated = stages.write(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if (n := repeated.count()) == 0:
        classes = stages.write(minhash.near_duplicates(docs), "classes")
        # Those that go are the fewer; joined by them, texts need no shuffle unless they are very many.
        gone = stages.write(classes.where("not kept").select("doc_id").distinct(), "gone")
        return docs.join(broadcast_if_small(gone, gone.count(), 16), "doc_id", "left_anti")
    # Rows of one id and text are one; different texts under one id get a number each, and are compared by it.
    few = broadcast_if_small(repeated, n, 16)
    rest = F.struct(*COLUMNS[2:])
    once = docs.join(few, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(rest).alias("rest")).select("doc_id", "text", "rest.*")
    rows = docs.join(few, "doc_id", "left_anti").unionByName(once)
    rows = stages.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    classes = stages.write(minhash.near_duplicates(rows, id_col="row"), "classes")
    named = classes.join(rows.select("row", "doc_id", F.xxhash64("text").alias("mark")), "row")
    best = named.groupBy("class_id").agg(F.min(F.struct("doc_id", "mark", "row"))["row"].alias("row"))
    gone = stages.write(classes.select("row").join(best, "row", "left_anti"), "gone")
    return rows.join(broadcast_if_small(gone, gone.count(), 16), "row", "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced, and n_chars counted anew where one was. Null texts stay null; every row stays."""
    found = secrets.scan(docs, public_vocabulary("byte_bpe_50k.tiktoken"), redact=REDACTED, keep=["lang", "source", "n_chars"])
    changed = F.size("spans") > 0
    return found.select(F.col("id").alias("doc_id"), "text", "lang", "source", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate takes it.

    Null and empty texts have no tokens and the rate of texts without any telling term; rows of one id have the same draw, so
    that ties are decided alike in every run.
    """
    rates = mixing.mix(docs, domain_labels(table(spark, sf_dir, "labels")), TARGETS, keep=["text", "lang", "source", "n_chars"])
    return rates.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences; null and empty texts are a piece of the end id alone, and
    documents taken several times are packed each time."""
    return packing.pack_documents(docs, public_vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: No stage but the fixed part of the secret scan can be said in SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stages.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            stages.drop(f"stage-{k - 1}")
    return docs
