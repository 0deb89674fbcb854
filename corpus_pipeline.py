"""A corpus pipeline: documents through a chain of stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps, with
their columns; the last returns what training reads. ``run`` writes what a stage
returns to the shared folder and gives it to the next one. A document is known by
its id and a hash of its text, so rows repeated in both share their fate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.llm import decontam, langid, pieces, secrets, simhash
from tableops.llm.base import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """All columns under numbered names, so that none clashes with what is added, and those ``used``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    return plain.select(*names, *[F.col(names[docs.columns.index(c)]).alias(c) for c in used]), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: no letter, or no profile nearer than all others.

    Text in a script no profile knows is at the greatest distance from each of them. The
    profiles are learned from the documents' own ``lang``.
    """
    own, names = _numbered(docs, "text", "lang")
    found = langid.identify(own, langid.train(own), *names)
    told = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") > 0)
    return found.where(told).select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints (three-word shingles) at three bits or fewer."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    own, names = _numbered(docs, "text")
    found = decontam.matches(own, table(spark, sf_dir, "benchmark"), *names)
    return found.where(F.size("matches") == 0).select(*names).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a live-looking credential: one that few sources hold."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    narrow = docs.select("doc_id", "text", "source", "lang", text_hash.alias("text_hash"))
    found = secrets.scan(
        narrow, "doc_id", "text_hash", repository=F.concat_ws("/", "source", "lang")
    )
    # staged, so that Spark knows its size before it decides to move the texts
    out = staged(
        found.where("n_live > 0").select(
            F.col("doc_id").alias("out_id"), F.col("text_hash").alias("out_hash")
        ),
        "secret-documents",
    )
    gone = docs["doc_id"].eqNullSafe(out["out_id"]) & (text_hash == out["out_hash"])
    return docs.join(out, gone, "left_anti")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as SentencePiece ids."""
    encoded = pieces.encode(docs, pieces.configured(spark), "doc_id", "lang", "source")
    return encoded.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

#: Fingerprints, windows and pieces are beyond SQL; tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
