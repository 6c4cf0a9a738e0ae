"""A training corpus from raw documents: judge, deduplicate, decontaminate, redact, mix.

Every stage takes and returns documents; ``run`` writes each stage's result to the shared
folder and gives it to the next.  A classifier, a compression dictionary and a mix cannot be
written as SQL, so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm.base import crc_bucket
from netweave.llm.decontaminate import contamination
from netweave.llm.mixing import mixed_documents
from netweave.llm.quality import fit_quality, score_quality
from netweave.llm.queries import QUALITY_CUT, table
from netweave.llm.secrets import redact_secrets
from netweave.llm.simhash import near_duplicates
from netweave.session import discard, discarding, materialize

ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with columns named by place, which clash with nothing, and the text's name there."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good ones.

    A null text is scored as the empty one; rows without an id are scored, but teach nothing;
    repeated rows share their fate.  Any other columns stay as they are.
    """
    labels = table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, crc_bucket(F.col("doc_id"), 4) != 2)
    plain, text = _numbered(docs)
    scored = score_quality(plain, model, plain.columns, text).where(F.col("score") >= QUALITY_CUT)
    return scored.select(*plain.columns).toDF(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, null after all others.

    Of rows with the same id the one whose columns come first stays, so that the choice does not
    depend on files or tasks.  Null texts are empty, and all empty texts are one group.
    """
    plain, text = _numbered(docs)
    key = plain.columns[docs.columns.index("doc_id")]
    frozen = materialize(plain.withColumn("_row", F.monotonically_increasing_id()), "documents")
    one = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"),
                   F.sha2(F.to_json(F.struct(*plain.columns)), 256).alias("columns"), F.col("_row").alias("row"))
    classes = near_duplicates(frozen.select(one.alias("_one"), F.col(text).alias("text")), key="_one")
    least = classes.where(F.col("_one") == F.col("component_id")).select(F.col("_one.row").alias("_row"))
    return frozen.join(least, "_row", "left_semi").select(*plain.columns).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark.

    Null and empty texts have no words and stay; repeated rows share their fate.
    """
    plain, text = _numbered(docs)
    found = contamination(plain, table(spark, sf_dir, "benchmark"), plain.columns, text)
    return found.where(F.size("hits") == 0).select(*plain.columns).toDF(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the names of their kinds; null texts stay null."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, numbered by ``copy`` (``copy_`` where that is taken).

    Draws follow ids and texts, so the same documents in another layout make the same mix.  Null
    and empty texts have no words and are not taken; a null source is a source of its own.
    """
    return mixed_documents(docs)


STAGES = [
    ("quality", quality),
    ("deduplicate", deduplicate),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one written and read again.

    What a stage wrote on its way is removed once its result is stored.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with discarding(spark) as keep:
            after = keep(stage(spark, docs, sf_dir), name)
        discard(spark, before)
        docs, before = spark.read.schema(after.schema).parquet(after.path), after.path
    return docs
