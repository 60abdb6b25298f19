"""The corpus pipeline: language, near-duplicates, contamination, personal data, tokens."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.llm import bpe, decontaminate, language, neardup, pii
from tallystream.llm._arrow import give_back_heap
from tallystream.llm._filter import by_weight, within, without
from tallystream.llm._scratch import remove, scope, shared_folder, staged
from tallystream.llm.queries import RANKS, held_out

#: Times the chance of a guess that a document's best language must reach.
OVER_CHANCE = 1.1
#: Share of correctly recognised held-out documents that may score below the least score.
LEAST_SHARE = 0.002
#: Row keys up to which a stage's rejects are broadcast, at under 60 bytes each.
BROADCAST_KEYS = 200_000


#: The column that tells rows apart; no stage returns it.
KEY = "__row_key"


def lean(stage: Callable) -> Callable:
    """The stage, which begins with executors whose heaps hold no garbage of earlier ones."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heap(spark)
        return stage(spark, docs, sf_dir)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``KEY``, which tells rows apart by id and text; equal rows share it."""
    return docs.withColumn(KEY, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string"), F.coalesce(F.char_length("text"), F.lit(-1)).cast("string")))


def least_score(found: DataFrame, labels: list[str]) -> float:
    """The score that a document's best language must reach, from identified documents.

    It is a low quantile of the scores of all held-out documents whose label is
    found, but ``OVER_CHANCE`` times that of a guess at least, which is all
    where too few of them are found to tell; with one label it is 0.  Scores
    have 4 digits, so the exact quantile takes a bounded table of counts.
    """
    if len(labels) < 2:
        return 0.0
    right = found.filter(held_out() & (F.col("lang") == F.col("lang_pred")))
    n, low = right.agg(F.count("*"), F.expr(f"percentile_disc({LEAST_SHARE}) WITHIN GROUP (ORDER BY score)")).collect()[0]
    return max(OVER_CHANCE / len(labels), low if n * LEAST_SHARE >= 1 else 0.0)


@lean
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing ``lang`` becomes the predicted one.

    Rejected are documents without a letter, and those whose best language
    scores below :func:`least_score`.  A prediction other than ``lang`` rejects none.
    """
    net = language.fit(docs, usable=~held_out("id"))
    found = staged(language.identify(docs, net, keep=("doc_id", "text", "lang", "source", "n_chars")), "languages")
    least = least_score(found, net.labels)
    kept = found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= least))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


@lean
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-equal sets of five-word shingles link: the one with the least id.

    Of rows that share the least id the one with the least key stays, once.
    Documents without words stay.
    """
    keyed = _keyed(docs)
    result = staged(neardup.near_duplicates(keyed, extra=(KEY,)), "decisions").filter(F.col("group").isNotNull())
    first = F.min(F.struct((~F.col("kept")).alias("late"), F.col(KEY).alias("key")))
    chosen = result.groupBy(F.col("group").alias("of")).agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    chosen = staged(chosen.select("of", F.col("first.key").alias("chosen"), "n"), "chosen")
    members = by_weight(result, "group", chosen, "of", "n", result.count()).filter("chosen IS NOT NULL")
    gone = members.filter(F.col(KEY) != F.col("chosen")).select(F.col(KEY).alias("gone")).distinct()
    kept = without(keyed, KEY, staged(gone, "gone"), BROADCAST_KEYS)
    repeated = staged(result.groupBy(KEY).count().filter("count > 1").select(F.col(KEY).alias("again")), "repeated")
    if repeated.isEmpty():
        return kept.drop(KEY)
    once = within(kept, KEY, repeated, "again", BROADCAST_KEYS).drop("again").dropDuplicates([KEY])
    return without(kept, KEY, repeated, BROADCAST_KEYS).unionByName(once).drop(KEY)


@lean
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    keyed = _keyed(docs)
    found = decontaminate.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), extra=(KEY,))
    gone = staged(found.filter("contaminated").select(F.col(KEY).alias("gone")).distinct(), "contaminated")
    return without(keyed, KEY, gone, BROADCAST_KEYS).drop(KEY)


@lean
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` is the new length."""
    clean = pii.redact(docs, pii.fit(docs), keep=("doc_id", "lang", "source"))
    return clean.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


@lean
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the bytes they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language", keep_languages),
    ("near-duplicates", drop_near_duplicates),
    ("contamination", drop_contaminated),
    ("personal-data", redact_personal_data),
    ("tokens", tokenize),
]
#: Most stages apply learned models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again.

    What a stage has staged goes when it is written, and its input with it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/tallystream-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{k}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
