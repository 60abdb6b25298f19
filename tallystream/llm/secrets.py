"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by patterns, their values hashed, and each hash counted by
distinct repositories and owners.  A value that several owners hold is a copied
example; one that a single owner holds looks live.  Long mixed tokens outside
the base kinds are only reported where their ownership says that they look
live.

Java's regular expressions give matches but no places.  The places of a
document's matches follow from the lengths of the matches and of what lies
between them, summed in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.llm._filter import by_weight
from tallystream.llm._scratch import staged


@dataclass(frozen=True)
class Kind:
    """A kind of candidate: its pattern, the value's group and least length, and what every match holds."""

    name: str
    pattern: str
    group: int
    least: int
    gate: str
    base: bool = True


#: In the order in which spans at one place are listed.  A run of 16 or more is matched where
#: the plain pattern matches one and then checks its length, as both take the longest run.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, "[:=]"),
    Kind("access", "AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Kind("hex", "[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
    Kind("generic", "[A-Za-z0-9+/_-]{24,}", 0, 24, "[A-Za-z0-9+/_-]{24}", base=False),
)
#: Owners and repositories from which on a value counts as copied.
COPIED_OWNERS, COPIED_REPOS = 2, 4


def _matches(text: Column, kind: Kind) -> Column:
    """For each match the characters before it (since the last one), its length, and its value; empty without the gate."""
    found = F.arrays_zip(
        F.transform(F.split(text, kind.pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.char_length).alias("length"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)).alias("value"),
    )
    found = F.filter(found, lambda x: x["length"].isNotNull())  # what follows the last match
    gate = text.contains(kind.gate) if kind.gate.isalnum() else text.rlike(kind.gate)
    return F.when(gate, found).otherwise(F.array().cast("array<struct<gap:int,length:int,value:string>>"))


def candidates(docs: DataFrame, doc_id: str, text: str, owner: Column, repo: Column) -> DataFrame:
    """One row a document row, staged: ``uid``, ``doc_id``, ``owner``, ``repo`` and the matches of each kind."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
    )
    return staged(rows.select("uid", "doc_id", "owner", "repo", *[_matches(t, k).alias(k.name) for k in KINDS]), "candidates")


def spans(found: DataFrame) -> DataFrame:
    """One row a candidate that passes its kind's check: ``uid``, ``owner``, ``repo``, ``kind`` (its place), ``start``, ``end`` and ``value``."""
    parts = []
    for place, kind in enumerate(KINDS):
        exploded = found.filter(F.size(kind.name) > 0).select("uid", "owner", "repo", F.lit(place).alias("kind"), F.posexplode(kind.name).alias("i", "m"))
        parts.append(exploded)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    order = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(order)
    rows = rows.select("uid", "owner", "repo", "kind", (end - F.col("m.length")).alias("start"), end.alias("end"), F.col("m.value").alias("value"))
    enough = F.lit(False)
    for place, kind in enumerate(KINDS):
        ok = F.char_length("value") >= kind.least
        if not kind.base:
            ok = ok & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
        enough = enough | ((F.col("kind") == place) & ok)
    return rows.filter(enough)


def ownership(found: DataFrame) -> DataFrame:
    """Each candidate hash with its spans, distinct owners and distinct repositories, over all documents."""
    held = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))  # before the shuffle, once a task
    held = held.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return held.groupBy(F.col("hash").alias("counted")).agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def _listed(spans_: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: Column | None = None, repo: Column | None = None, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """Secrets in every text; one row a document row.

    Columns ``doc_id``, ``n_assign``, ``n_access`` and ``n_hex`` (base spans),
    ``base_sha256``, ``spans`` (base spans and the added ones), ``held`` (for
    each of ``spans``, in order, ``class:owners:repositories`` of its value,
    comma-joined), ``n_live`` and ``n_copied`` (spans of either class).  A value is
    ``copied`` if at least ``copied_owners`` owners or ``copied_repos``
    repositories hold it, else ``live``.  A repository is one of its owner's.
    A null or empty text has no spans.  All rows without owner are one owner's,
    and those of an owner without repository one repository's.  Repeated rows
    each give a row and count once for ownership.
    """
    owner = F.col("source") if owner is None else owner
    repo = owner if repo is None else repo
    found = candidates(docs, doc_id, text, owner, repo)
    rows = staged(spans(found).withColumn("hash", F.sha2(F.col("value").cast("binary"), 256)).drop("value"), "spans")
    held = staged(ownership(rows), "ownership")
    total = held.agg(F.sum("n_spans")).collect()[0][0] or 0
    classed = by_weight(rows, "hash", held, "counted", "n_spans", total)
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)
    base = F.col("kind").isin([i for i, k in enumerate(KINDS) if k.base])
    classed = classed.select("uid", "kind", "start", "end", base.alias("base"), copied.alias("copied"), "n_owners", "n_repos")
    order = Window.partitionBy("uid").orderBy("start", "kind")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    apart = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    kept = classed.withColumn("apart", apart).filter(F.col("base") | (F.col("apart") & ~F.col("copied")))
    one = lambda c: F.count_if(c)
    per_doc = kept.groupBy(F.col("uid").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base", "copied", "n_owners", "n_repos"))).alias("all"),
        *[one(F.col("kind") == i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base],
        one(~F.col("copied")).alias("n_live"), one("copied").alias("n_copied"),
    )
    counts = [f"n_{k.name}" for k in KINDS if k.base]
    ownership_of = lambda x: F.concat_ws(":", F.when(x["copied"], "copied").otherwise("live"), x["n_owners"].cast("string"), x["n_repos"].cast("string"))
    per_doc = per_doc.select("of", *counts, "n_live", "n_copied", F.array_join(F.transform("all", ownership_of), ",").alias("held"), _listed(F.filter("all", lambda x: x["base"])).alias("base_spans"), _listed(F.col("all")).alias("spans"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.select("uid", "doc_id").join(per_doc, F.col("uid") == F.col("of"), "left").select(
        "doc_id", *map(zero, counts), F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("held", F.lit("")).alias("held"), zero("n_live"), zero("n_copied"),
    )
