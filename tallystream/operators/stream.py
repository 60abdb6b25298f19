"""Ordered logs: appends, reads, retention, compaction, groups and transactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions.hashes import partition_for
from tallystream.operators.ordered import PER_BUCKET, carried, dense_number, first_per, number_bucket, running_total, running_totals
from tallystream.sources.envelopes import ENVELOPE
from tallystream.sources.tiers import digests

#: Milliseconds of log whose rows are numbered in one task.
BUCKET_MS = 3_600_000
#: Fields of a record, in the order of its canonical JSON.
RECORD_FIELDS = ("partition", "offset", "appended_at_ms", *ENVELOPE.names)
#: Records of an atomic batch, of a tier object, and of a replicated batch at most.
MAX_BATCH, MAX_TIER, MAX_REPLICATED = 1_000, 1_024, 128


class Conflict(ValueError):
    """A request that the state of a log excludes."""


def append(envelopes: DataFrame, partitions: int, order: tuple[str, ...] = ("time_ms", "event_id"), dedupe: bool = False, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Envelopes as records: with ``partition``, dense ``offset`` and ``appended_at_ms``.

    With ``dedupe`` the first envelope of each dedupe id over all partitions is
    taken, and what follows uses no offset.
    """
    rows = first_per(envelopes, "dedupe_id", list(order)) if dedupe else envelopes
    rows = rows.withColumn("partition", partition_for(F.col("key"), F.col("id"), partitions)).withColumn("appended_at_ms", F.col("time_ms"))
    bucket = F.floor(F.col(order[0]) / bucket_ms) if bucket_ms else None
    return dense_number(rows, ["partition"], list(order), "offset", 0, bucket)


def commit_positions(rows: DataFrame, order: tuple[str, ...] = ("time_ms", "event_id"), bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Adds ``commit_position``, dense from 1 over the whole log; only the buckets' totals meet in one task."""
    return dense_number(rows, [], list(order), "commit_position", 1, F.floor(F.col(order[0]) / bucket_ms))


def bounds(records: DataFrame) -> DataFrame:
    """Base and end offset, rows and bytes of each partition of a log that nothing was removed from.

    What removes records moves them with :func:`bounds_after`, as what is left
    doesn't tell where a partition begins, or ends when nothing is left.
    """
    return records.groupBy("partition").agg(
        F.min("offset").alias("base_offset"), (F.max("offset") + 1).alias("end_offset"), F.count("*").alias("records"), F.sum(record_bytes(records)).alias("bytes")
    )


def bounds_after(limits: DataFrame, marked: DataFrame, compaction: bool = False) -> DataFrame:
    """The bounds of each partition after what isn't ``kept`` is removed.

    Retention moves the base to the first record that stays, or to the end if
    none does; compaction leaves it.  The end never moves.
    """
    left = marked.filter("kept").groupBy(F.col("partition").alias("_p")).agg(F.min("offset").alias("_first"), F.count("*").alias("_records"), F.sum(record_bytes(marked)).alias("_bytes"))
    rows = limits.join(left, F.col("partition") == F.col("_p"), "left")
    base = F.col("base_offset") if compaction else F.greatest("base_offset", F.coalesce("_first", "end_offset"))
    zero = F.lit(0).cast("bigint")
    return rows.select("partition", base.alias("base_offset"), "end_offset", F.coalesce("_records", zero).alias("records"), F.coalesce("_bytes", zero).alias("bytes"))


def record_bytes(records: DataFrame) -> Column:
    """Bytes of a record's canonical JSON: the fields of an envelope and record that ``records`` has and that aren't null, the payload as it is."""
    names = [c for c in RECORD_FIELDS if c in records.columns and c != "payload"]
    rest = F.octet_length(F.to_json(F.struct(*names)))
    return (rest + F.coalesce(F.octet_length("payload") + len(',"payload":'), F.lit(0))).cast("bigint")


def known_bounds(limits: DataFrame) -> dict[int, tuple[int, int]]:
    """Base and end of each partition, of which a log has a bounded number, by partition."""
    return {r["partition"]: (r["base_offset"], r["end_offset"]) for r in limits.select("partition", "base_offset", "end_offset").collect()}


def fetch(records: DataFrame, limits: dict[int, tuple[int, int]], partition: int, offset: int, limit: int) -> DataFrame:
    """Up to ``limit`` records of a partition from an offset on; an offset before the base raises Conflict.

    ``limits`` are the log's :func:`known_bounds`; an unknown partition raises ValueError.
    """
    if partition not in limits:
        raise ValueError(f"no partition {partition}")
    if offset < limits[partition][0]:
        raise Conflict(f"offset {offset} is before {limits[partition][0]}")
    return records.filter((F.col("partition") == partition) & (F.col("offset") >= offset)).orderBy("offset").limit(limit)


def fetch_each(records: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` records of each partition from its ``start`` on; offsets may have holes."""
    rows = records.join(starts, "partition").filter(F.col("offset") >= F.col("start"))
    rank = Window.partitionBy("partition").orderBy("offset")
    return rows.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= limit).drop("_rank", "start")


def fetch_for_group(records: DataFrame, limits: DataFrame, offsets: DataFrame, group: str, limit: int, owner: tuple[str, int] | None = None, claimed: tuple[str, int] | None = None) -> DataFrame:
    """Records of every partition from a group's committed offset, or the base, on.

    If ``claimed`` names who owns the group and of which generation, ``owner``
    must be the same, or Conflict is raised.
    """
    if claimed is not None and owner != claimed:
        raise Conflict(f"{group} is owned by {claimed}")
    mine = offsets.filter(F.col("group") == group).select("partition", "committed")
    starts = limits.join(mine, "partition", "left").select("partition", F.greatest(F.coalesce("committed", "base_offset"), "base_offset").alias("start"))
    return fetch_each(records, starts, limit)


def apart(key: Column, *of: str) -> Column:
    """A join key that is never null: rows without key get one of their own, from ``of``, that matches nothing.

    Otherwise all of them would meet in one task of a shuffled outer join.
    """
    return F.coalesce(key, F.concat_ws(":", F.lit("\0"), *of))


def visible(records: DataFrame, transactions: DataFrame, committed: bool = True) -> DataFrame:
    """Records that a reader sees: with ``committed``, those without transaction or of a committed one; unknown ones are hidden."""
    if not committed:
        return records
    done = transactions.filter("status = 'committed'").select(F.col("transaction_id").alias("_done")).distinct()
    key = apart(F.col("transaction_id"), "partition", "offset")
    return records.join(done, key == F.col("_done"), "left").filter("transaction_id IS NULL OR _done IS NOT NULL").drop("_done")


def tiered(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Records of both, once an offset, the hot one where both have it."""
    both = hot.withColumn("_tier", F.lit(0)).unionByName(cold.withColumn("_tier", F.lit(1)))
    rank = Window.partitionBy("partition", "offset").orderBy("_tier")
    return both.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank", "_tier")


def tier_prefix(records: DataFrame, pending: DataFrame, before: int, most: int) -> DataFrame:
    """The longest prefix of each partition below ``before`` that a pending transaction doesn't stop, up to ``most`` records (1 to 1,024)."""
    if not 1 <= most <= MAX_TIER:
        raise ValueError("a tier object has 1 to 1,024 records")
    stop = records.join(pending.select("transaction_id").distinct(), "transaction_id", "left_semi").groupBy("partition").agg(F.min("offset").alias("stop"))
    rows = records.join(stop, "partition", "left").filter(F.col("offset") < F.least(F.lit(before), F.coalesce("stop", F.lit(before))))
    rank = Window.partitionBy("partition").orderBy("offset")
    return rows.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= most).drop("_rank", "stop")


@dataclass(frozen=True)
class Retention:
    """What a partition keeps: so many records, bytes of records, and milliseconds; None is no limit."""

    max_records: int | None = None
    max_bytes: int | None = None
    max_age_ms: int | None = None


def retained(records: DataFrame, policy: Retention, now_ms: int, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Adds ``kept``: whether each record is in the suffix that the policy keeps.

    Equal to retention after every append if append times don't decrease.
    """
    bucket = F.floor(F.col("appended_at_ms") / bucket_ms) if bucket_ms else None
    limits = {"_records": (F.lit(1), policy.max_records), "_bytes": (record_bytes(records), policy.max_bytes)}
    limits = {c: x for c, x in limits.items() if x[1] is not None}
    rows = running_totals(records, ["partition"], ["offset"], {c: value for c, (value, _) in limits.items()}, bucket, newest_first=True)
    kept = F.lit(True)
    for c, (_, most) in limits.items():
        kept = kept & (F.col(c) <= most)
    if policy.max_age_ms is not None and now_ms >= policy.max_age_ms:
        kept = kept & (F.col("appended_at_ms") > now_ms - policy.max_age_ms)
    return rows.withColumn("kept", kept).drop("_records", "_bytes")


def reconfigured(records: DataFrame, policies: list[Retention], now_ms: int, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Adds ``kept`` after one policy took the place of another, in turn, each maintained at ``now_ms``: what one removed stays removed."""
    kept = F.lit(True)
    rows = records
    for n, policy in enumerate(policies):
        rows = retained(rows, policy, now_ms, bucket_ms).withColumnRenamed("kept", f"_kept_{n}")
        kept = kept & F.col(f"_kept_{n}")
    return rows.withColumn("kept", kept).drop(*[f"_kept_{n}" for n in range(len(policies))])


def retention_report(marked: DataFrame) -> DataFrame:
    """Removed and retained records and bytes of each partition, and of all where ``partition`` is null."""
    size = record_bytes(marked)
    return marked.rollup("partition").agg(
        F.count_if(~F.col("kept")).alias("removed_records"), F.coalesce(F.sum(F.when(~F.col("kept"), size)), F.lit(0)).alias("removed_bytes"),
        F.count_if("kept").alias("retained_records"), F.coalesce(F.sum(F.when(F.col("kept"), size)), F.lit(0)).alias("retained_bytes"),
    )


def compaction_report(marked: DataFrame) -> DataFrame:
    """Records, bytes and tombstones that compaction removes from each partition."""
    gone = ~F.col("kept")
    return marked.groupBy("partition").agg(
        F.count_if(gone).alias("removed"), F.coalesce(F.sum(F.when(gone, record_bytes(marked))), F.lit(0)).alias("removed_bytes"), F.count_if(gone & F.col("payload").isNull()).alias("removed_tombstones")
    )


def compacted(records: DataFrame, transactions: DataFrame, now_ms: int, tombstone_ms: int) -> DataFrame:
    """Adds ``kept`` after compaction by key.

    The latest visible record of each key stays, and a latest one without
    payload until its time is over.  Records without key stay unless their
    transaction was aborted, and those of pending transactions always.
    """
    status = transactions.select(F.col("transaction_id").alias("_tx"), F.col("status").alias("_status"))
    rows = records.join(status, apart(F.col("transaction_id"), "partition", "offset") == F.col("_tx"), "left")
    seen = F.col("transaction_id").isNull() | F.coalesce(F.col("_status") == "committed", F.lit(False))
    keyless = F.coalesce("key", F.lit("")) == ""
    latest = rows.filter(seen & ~keyless).groupBy(F.col("partition").alias("_p"), F.col("key").alias("_k")).agg(F.max("offset").alias("_latest"))
    key = apart(F.when(~keyless, F.col("key")), "offset")
    rows = rows.join(latest, (F.col("partition") == F.col("_p")) & (key == F.col("_k")), "left")
    live = F.col("payload").isNotNull() | (F.col("appended_at_ms") + tombstone_ms > now_ms)
    kept = (
        F.when(F.coalesce(F.col("_status") == "pending", F.lit(False)), F.lit(True))
        .when(F.coalesce(F.col("_status") == "aborted", F.lit(False)), F.lit(False))
        .when(keyless, F.lit(True))
        .otherwise(F.coalesce(F.col("offset") == F.col("_latest"), F.lit(False)) & live)
    )
    return rows.withColumn("kept", kept).drop("_tx", "_status", "_p", "_k", "_latest")


def lag(limits: DataFrame, offsets: DataFrame) -> DataFrame:
    """Lag of each group and partition: ``end - max(committed, base)``; a group without an offset starts at the base."""
    rows = limits.join(offsets, "partition")
    committed = F.coalesce("committed", "base_offset")
    return rows.select(
        "group", "partition", "base_offset", committed.alias("committed"), "end_offset",
        F.greatest(F.col("end_offset") - F.greatest(committed, "base_offset"), F.lit(0)).alias("lag"), (committed < F.col("base_offset")).alias("out_of_range"),
    )


def commits(commands: DataFrame, limits: DataFrame, per_bucket: int | None = PER_BUCKET) -> DataFrame:
    """Offset commands (``group``, ``partition``, ``seq``, ``op`` commit or reset, ``offset``) with ``accepted``.

    A reset is accepted between the bounds, a commit between what is committed
    (the base at first) and the end.  Between two accepted resets what is
    committed is the largest offset so far that lies between the bounds, so no
    fold is needed.  Without a group or a partition none is accepted.
    """
    rows = commands.join(limits.select("partition", "base_offset", "end_offset"), "partition", "left")
    rows = rows.withColumn("_inside", F.coalesce(F.col("offset").between(F.col("base_offset"), F.col("end_offset")), F.lit(False)) & F.col("group").isNotNull())
    reset = F.col("_inside") & F.coalesce(F.col("op") == "reset", F.lit(False))
    bucket = None if per_bucket is None else number_bucket("seq", per_bucket)
    rows = running_total(rows, ["group", "partition"], ["seq"], reset.cast("int"), "_part", bucket)
    rows = carried(rows, ["group", "partition", "_part"], "seq", F.when(F.col("_inside"), F.col("offset")), "_most", per_bucket)
    accepted = F.col("_inside") & (reset | (F.col("offset") >= F.coalesce("_most", "base_offset")))
    return rows.withColumn("accepted", accepted).drop("_inside", "_part", "_most", "base_offset", "end_offset")


def superstream(members: dict[str, DataFrame], limit: int) -> DataFrame:
    """The first records of several logs by time, member, partition and offset."""
    rows = None
    for name, member in members.items():
        part = member.withColumn("member", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows.orderBy("appended_at_ms", "member", "partition", "offset").limit(limit)


def advice(totals: DataFrame, target_records: int, target_bytes: int) -> DataFrame:
    """Partitions to have, from ``current``, ``records`` and ``bytes``, and which of the two asks for them (bytes on a tie)."""
    if target_records < 1 or target_bytes < 1:
        raise ValueError("targets must be positive")
    by_records, by_bytes = (F.greatest(F.ceil(F.col(c) / n).cast("bigint"), F.lit(1)) for c, n in (("records", target_records), ("bytes", target_bytes)))
    wanted = F.greatest(by_records, by_bytes, F.col("current").cast("bigint"))
    reason = F.when(wanted <= F.col("current"), F.lit("within_target")).when(by_bytes >= by_records, F.lit("retained_bytes")).otherwise(F.lit("retained_records"))
    return totals.select("*", wanted.alias("advised"), reason.alias("reason"))


def assignment(members: DataFrame, member: str, shards: int) -> DataFrame:
    """Shards of each member: in name order, shard s goes to member s modulo their number."""
    order = Window.orderBy("member")  # a group has at most 1,024 members
    ranked = members.select(F.col(member).alias("member")).distinct().withColumn("place", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("members", F.count("*").over(Window.partitionBy()))
    return ranked.select("member", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s % F.col("members") == F.col("place"))).alias("shard"))


def replicated(batch: DataFrame, source_cluster: str, local_cluster: str, checkpoint: int) -> DataFrame:
    """Foreign records to append: beyond the checkpoint and not through here before, with their provenance and a dedupe id."""
    here = F.array_contains("traversed_clusters", local_cluster)
    rows = batch.filter((F.col("offset") >= checkpoint) & ~here)
    extra = F.create_map(
        F.lit("origin_cluster"), F.lit(source_cluster), F.lit("origin_partition"), F.col("partition").cast("string"), F.lit("origin_offset"), F.col("offset").cast("string"),
        F.lit("traversed"), F.concat_ws(",", F.concat("traversed_clusters", F.array(F.lit(source_cluster)))),
    )
    own = F.map_filter("extensions", lambda k, _: ~k.isin("origin_cluster", "origin_partition", "origin_offset", "traversed"))
    default = F.concat_ws("/", F.lit("repl"), F.lit(source_cluster), F.col("partition").cast("string"), F.col("offset").cast("string"))
    return rows.withColumn("extensions", F.map_concat(own, extra)).withColumn("dedupe_id", F.coalesce("dedupe_id", default))


def replication_outcomes(batch: DataFrame, checkpoints: DataFrame, local_cluster: str) -> DataFrame:
    """What becomes of a foreign batch, one row a source partition.

    Columns ``partition``, ``first_offset``, ``next_offset``, ``digest`` (of the
    records) and ``outcome``: ``duplicate`` if the checkpoint (``partition``,
    ``next_offset``, ``last_digest``) has this digest, ``conflict`` if the batch
    doesn't begin where the checkpoint is (0 for a new source), ``invalid`` if
    offsets aren't contiguous or there are over 128 of them, ``loop`` if a
    record has passed here, else ``accepted``.  A partition's records are taken
    all or none.
    """
    loop = F.array_contains("traversed_clusters", local_cluster)
    rows = batch.groupBy("partition").agg(F.count_distinct("offset").alias("_distinct"), F.bool_or(F.coalesce(loop, F.lit(False))).alias("_loop"))
    rows = digests(batch).join(rows, "partition").join(checkpoints.select("partition", F.col("next_offset").alias("_at"), "last_digest"), "partition", "left")
    whole = (F.col("end_offset") - F.col("first_offset") == F.col("records")) & (F.col("_distinct") == F.col("records")) & (F.col("records") <= MAX_REPLICATED)
    outcome = (
        F.when(F.coalesce(F.col("digest") == F.col("last_digest"), F.lit(False)), "duplicate")
        .when(F.col("first_offset") != F.coalesce("_at", F.lit(0)), "conflict")
        .when(~whole, "invalid").when(F.col("_loop"), "loop").otherwise("accepted")
    )
    return rows.select("partition", "first_offset", F.col("end_offset").alias("next_offset"), "digest", outcome.alias("outcome"))


def accepted(batch: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The records of the partitions that :func:`replication_outcomes` accepts."""
    return batch.join(outcomes.filter("outcome = 'accepted'").select("partition"), "partition", "left_semi")


def batch_receipts(rows: DataFrame, partitions: int, order: tuple[str, ...] = ("time_ms", "event_id"), bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Atomic batches of envelopes (``batch``, ``client_sequence``) as records with a receipt each.

    A batch with no record or over 1,000, or with a sequence twice or missing,
    is left out as a whole.  Columns of :func:`append` and those of the batch.
    """
    whole = rows.groupBy(F.col("batch").alias("_batch")).agg(F.count("*").alias("_n"), F.count_distinct("client_sequence").alias("_distinct"))
    whole = whole.filter((F.col("_n") <= MAX_BATCH) & (F.col("_n") == F.col("_distinct"))).select("_batch")
    return append(rows.join(whole, F.col("batch") == F.col("_batch"), "left_semi"), partitions, order, bucket_ms=bucket_ms)


def expired_owners(owned: DataFrame, sessions: DataFrame, now_ms: int) -> DataFrame:
    """Owned partitions (``partition``, ``member``) whose member has no session that is still alive (``expires_at_ms`` after now)."""
    alive = sessions.filter(F.col("expires_at_ms") > now_ms).select("member").distinct()
    return owned.join(alive, "member", "left_anti")


def due(schedules: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """Schedules whose time has come (``name``, ``next_at_ms``), by time and name."""
    return schedules.filter(F.col("next_at_ms") <= now_ms).orderBy("next_at_ms", "name").limit(limit)


def transaction_status(commands: DataFrame) -> DataFrame:
    """The status of each transaction from its commands: the first end decides, else it is pending."""
    ends = F.min(F.when(F.col("action").isin("commit", "abort"), F.struct("seq", "action")))
    rows = commands.groupBy("transaction_id").agg(ends.alias("end"), F.count_if(F.col("action") == "append").alias("records"))
    status = F.when(F.col("end.action") == "commit", "committed").when(F.col("end.action") == "abort", "aborted").otherwise("pending")
    return rows.select("transaction_id", status.alias("status"), "records")


def sequence_report(appends: DataFrame, per_bucket: int | None = PER_BUCKET) -> DataFrame:
    """How each producer's appends follow each other within a term: ``first``, ``next``, ``repeat`` or ``gap``.

    For reports only; what is accepted is decided by the producer fold.
    """
    rows = carried(appends, ["producer", "term"], "seq", F.col("sequence"), "_most", per_bucket)
    before = F.col("_most")
    kind = F.when(before.isNull(), "first").when(F.col("sequence") == before + 1, "next").when(F.col("sequence") <= before, "repeat").otherwise("gap")
    return rows.withColumn("kind", kind).drop("_most")


def hybrid_clock(ticks: DataFrame, node: str, order: str, physical: str, per_bucket: int | None = PER_BUCKET) -> DataFrame:
    """Adds ``clock_ms`` and ``logical`` of a hybrid logical clock's ticks: the largest time so far, and the ticks since it grew."""
    rows = carried(ticks, [node], order, F.col(physical), "clock_ms", per_bucket, inclusive=True)
    run = Window.partitionBy(node, "clock_ms").orderBy(order)
    return rows.withColumn("logical", (F.row_number().over(run) - 1).cast("bigint"))


def hybrid_clock_observed(ticks: DataFrame, node: str, order: str, physical: str, remote_ms: str, remote_logical: str, per_bucket: int | None = PER_BUCKET) -> DataFrame:
    """As :func:`hybrid_clock`, of ticks that may observe a remote clock (null: a tick of its own).

    The time is the largest so far, own or remote.  While it stays, the counter
    is one more than before, and than the remote counter if that clock has the
    same time; a new time of the own clock begins at 0.
    """
    rows = carried(ticks, [node], order, F.greatest(F.col(physical), F.col(remote_ms)), "clock_ms", per_bucket, inclusive=True)
    run = Window.partitionBy(node, "clock_ms").orderBy(order)
    rows = rows.withColumn("_n", F.row_number().over(run))
    start = F.when(F.col(remote_ms) == F.col("clock_ms"), F.col(remote_logical) + 1).when(F.col("_n") == 1, F.lit(0))
    run = run.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("logical", (F.col("_n") + F.max(start - F.col("_n")).over(run)).cast("bigint")).drop("_n")
