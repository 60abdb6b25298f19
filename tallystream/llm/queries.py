"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.llm import archive, bpe, decontaminate, gif, language, neardup, pii, quality, secrets, toxicity
from tallystream.llm._scratch import settled

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidied(query: Callable) -> Callable:
    """The query, which leaves nothing in the shared folder but its result."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return settled(spark, lambda: query(spark, sf_dir))

    return run


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity categories of every whole document; one row each."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"), F.col("toxic") == 1))


@tidied
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of benchmark items in every whole document; one row each."""
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@tidied
def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents, on two-word shingles; one row each."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=2).drop("group")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document; one row each."""
    docs = _table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit(docs))


@tidied
def op5_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC archives and back; one row each."""
    return archive.archived_pages(_table(spark, sf_dir, "pages"))


@tidied
def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document stored as an animation and read back; one row each."""
    return gif.media_columns(_table(spark, sf_dir, "documents"))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: a quarter, by a checksum of its id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document; one row each."""
    docs = _table(spark, sf_dir, "documents")
    net = language.fit(docs, usable=~held_out("id"))
    return language.identify(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_bytes")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded; one row each."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@tidied
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every whole document and whether its language's limit keeps it; one row each.  A quarter of the low labels is held out."""
    labels = _table(spark, sf_dir, "labels")
    good, low = (quality.trusted_ids(labels, x) for x in (F.col("quality") == 1, (F.col("quality") == 0) & ~held_out()))
    return quality.assess(_table(spark, sf_dir, "documents"), good, low=low)


@tidied
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document; one row each.  A source is an owner, and its documents of a language a repository."""
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_neardup": op3_neardup,
    "op4_pii": op4_pii,
    "op5_archive": op5_archive,
    "op6_gif": op6_gif,
    "op7_bpe": op7_bpe,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
}
SQL: dict[str, str] = {"op2_decontaminate": decontaminate.SQL, "op3_neardup": neardup.SQL}
