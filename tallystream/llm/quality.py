"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is a table of the n-grams of all trusted documents
(:mod:`tallystream.llm.ngrams`), which grows with them.  A document's loss
comes from joining its n-grams with that table in shards, and the limit is a
quantile of the trusted documents of its language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.llm import ngrams
from tallystream.llm._filter import within
from tallystream.llm._scratch import staged

#: Trusted ids up to which they are broadcast, at 8 bytes each.
BROADCAST_IDS = 1_000_000
#: Languages up to which their limits are broadcast.
BROADCAST_LANGS = 10_000
QUANTILE = 0.995
#: Quantiles that labelled low-quality rows choose among for a language.
CHOICES = [0.98, 0.985, 0.99, 0.995]


def assess(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, low: DataFrame | None = None) -> DataFrame:
    """Perplexity and decision of every row; one row a document row.

    ``trusted`` has the ids of trusted documents.  Columns ``doc_id``,
    ``n_bytes``, ``perplexity`` (a byte's, rounded), ``limit`` (the quantile of the
    trusted documents of the language, or of all if it has none; approximate in
    rank by 1e-4) and ``kept`` (perplexity up to the limit).  Where a language
    has rows whose ids are in ``low``, its limit is that quantile of ``CHOICES``
    for which the share of them above it and the quantile have the largest sum,
    the highest if several do.  A null or empty text has no perplexity and isn't
    kept; without any trusted text none has a limit and all with text are kept.
    A null language is ``und``.  Repeated rows are counted and scored each.
    ``docs`` is read several times and must give the same rows in the same order.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    ids = trusted.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("known")).distinct()
    table = ngrams.model(within(rows, "doc_id", ids, "known", BROADCAST_IDS).select("text"))
    side = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids.hint("merge")
    found = ngrams.scores(rows, table).join(side, F.col("doc_id") == F.col("known"), "left")
    perplexity = F.when(F.col("n_bytes") > 0, F.round(F.exp(F.col("loss") / F.col("n_bytes")), 4))
    scored = found.select("doc_id", "lang", F.col("known").isNotNull().alias("trusted"), "n_bytes", perplexity.alias("perplexity"))
    return _decided(staged(scored, "scores"), quantile, low if low is None else low.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("bad")).distinct())


def _chosen(scored: DataFrame, good: DataFrame, limits: DataFrame, low: DataFrame) -> DataFrame:
    """``limits`` with ``own`` at the quantile that the rows in ``low`` choose."""
    levels = good.groupBy(F.col("lang").alias("at")).agg(F.percentile_approx("perplexity", CHOICES, 10_000).alias("levels"))
    levels = F.broadcast(levels) if levels.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS else levels
    side = F.broadcast(low) if low.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else low.hint("merge")
    rows = scored.filter("perplexity IS NOT NULL AND NOT trusted").join(side, F.col("doc_id") == F.col("bad"), "left_semi").join(levels, F.col("lang") == F.col("at"))
    gains = [F.struct((F.avg((F.col("perplexity") > F.col("levels")[k]).cast("double")) + q).alias("gain"), F.lit(q).alias("q"), F.first(F.col("levels")[k]).alias("level")) for k, q in enumerate(CHOICES)]
    best = rows.groupBy("at").agg(F.greatest(*gains)["level"].alias("level"))
    return limits.join(best, F.col("of") == F.col("at"), "left").select("of", F.coalesce("level", "own").alias("own"))


def _decided(scored: DataFrame, quantile: float, low: DataFrame | None = None) -> DataFrame:
    """Limits of the languages, and the decision of each row."""
    good = scored.filter("trusted AND perplexity IS NOT NULL")
    level = F.percentile_approx("perplexity", quantile, 10_000)
    limits = good.groupBy(F.col("lang").alias("of")).agg(level.alias("own"))
    overall = good.agg(level.alias("overall")).collect()[0]["overall"]
    limit = F.coalesce("own", F.lit(overall).cast("double"))
    limits = limits if low is None else _chosen(scored, good, limits, low)
    limits = F.broadcast(limits) if limits.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS else limits
    out = scored.join(limits, F.col("lang") == F.col("of"), "left")
    kept = F.col("perplexity").isNotNull() & (F.col("perplexity") <= F.coalesce(limit, F.col("perplexity")))
    return out.select("doc_id", "n_bytes", "perplexity", limit.alias("limit"), kept.alias("kept"))


def trusted_ids(labels: DataFrame, good: Column, doc_id: str = "doc_id") -> DataFrame:
    """Ids of the labelled rows that are ``good``."""
    return labels.filter(good).select(doc_id)
