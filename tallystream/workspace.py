"""A folder of named resources: streams, queues, caches and buses, with one call for each of their operations."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators import bus, cache, stream
from tallystream.sources.envelopes import validated
from tallystream.streaming import drivers, folds

KINDS = ("bus", "cache", "queue", "stream")
#: What answers a kind's commands.
_MAKERS = {"queue": folds.QueueFold, "cache": folds.CacheFold, "bus": folds.SubscriptionFold}


class Workspace:
    """Resources below a folder of any store that Spark reads.

    A stream's records and an archive's events are Parquet; commands of queues,
    caches and buses are kept with their answers, and the state after them as
    JSON, a row a resource.  One writer at a time: calls that change a resource
    aren't to run side by side.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _folder(self, kind: str, name: str) -> str:
        folder = f"{self.root}/{kind}/{name}"
        if not self._exists(f"{folder}/config"):
            raise KeyError(f"{kind}:{name}")
        return folder

    def create(self, kind: str, name: str, **config) -> None:
        """Makes a resource; a stream takes ``partitions``."""
        if kind not in KINDS or not re.fullmatch(r"[A-Za-z0-9._-]{1,128}", name):
            raise ValueError(f"bad resource {kind}:{name}")
        folder = f"{self.root}/{kind}/{name}"
        if self._exists(f"{folder}/config"):
            raise ValueError(f"{kind}:{name} exists")
        self.spark.createDataFrame([(kind, name, json.dumps(config))], "kind string, name string, config string").coalesce(1).write.json(f"{folder}/config")

    def resources(self) -> DataFrame:
        """All resources (``kind``, ``name``), by both."""
        rows = None
        for kind in KINDS:
            if self._exists(f"{self.root}/{kind}"):
                part = self.spark.read.schema("kind string, name string").json(f"{self.root}/{kind}/*/config")
                rows = part if rows is None else rows.unionByName(part)
        return (self.spark.createDataFrame([], "kind string, name string") if rows is None else rows).orderBy("kind", "name")

    def health(self) -> dict:
        """How many resources there are, and of which kinds."""
        rows = self.resources().groupBy("kind").count().collect()
        return {"status": "ok", "resources": sum(r["count"] for r in rows), "kinds": sorted(r["kind"] for r in rows)}

    def _config(self, kind: str, name: str) -> dict:
        row = self.spark.read.schema("config string").json(f"{self._folder(kind, name)}/config").first()
        return json.loads(row["config"])

    # --- streams

    def _limits(self, name: str) -> tuple[int, str, DataFrame]:
        """The version of a stream's bounds, the folder of its records, and the bounds, a row a partition."""
        folder = self._folder("stream", name)
        kinds = "partition int, base_offset long, end_offset long, records long, bytes long"
        if not self._exists(f"{folder}/bounds"):
            partitions = int(self._config("stream", name).get("partitions", 1))
            return 0, f"{folder}/records", self.spark.createDataFrame([(p, 0, 0, 0, 0) for p in range(partitions)], kinds)
        rows = self.spark.read.schema(f"version long, folder string, {kinds}").json(f"{folder}/bounds")
        last = rows.agg(F.max_by(F.struct("version", "folder"), "version").alias("last")).first()["last"]
        return last["version"], last["folder"], rows.filter(F.col("version") == last["version"]).drop("version", "folder")

    def _set_limits(self, name: str, version: int, records: str, limits: DataFrame) -> None:
        rows = limits.select(F.lit(version).alias("version"), F.lit(records).alias("folder"), "*")
        rows.coalesce(1).write.mode("append").json(f"{self._folder('stream', name)}/bounds")

    def append(self, name: str, envelopes: DataFrame) -> int:
        """Appends valid envelopes, numbered from each partition's end on, and returns how many; an invalid one is an error."""
        if not validated(envelopes).filter("problem IS NOT NULL").isEmpty():
            raise ValueError("an envelope is invalid")
        version, folder, limits = self._limits(name)
        ends = limits.select("partition", F.col("end_offset").alias("_end"))
        rows = stream.append(envelopes, int(self._config("stream", name).get("partitions", 1)))
        rows = rows.join(ends, "partition", "left").withColumn("offset", F.col("offset") + F.coalesce("_end", F.lit(0))).drop("_end").persist()
        count = rows.count()
        rows.write.mode("append").parquet(folder)
        added = rows.groupBy("partition").agg(F.count("*").alias("_n"), F.sum(stream.record_bytes(rows)).alias("_bytes"))
        more = lambda c: F.coalesce(c, F.lit(0))
        after = limits.join(added, "partition", "left").select(
            "partition", "base_offset", (F.col("end_offset") + more("_n")).alias("end_offset"), (F.col("records") + more("_n")).alias("records"), (F.col("bytes") + more("_bytes")).alias("bytes")
        )
        self._set_limits(name, version + 1, folder, after)
        rows.unpersist()
        return count

    def bounds(self, name: str) -> DataFrame:
        """Base and end offset, rows and bytes of each partition, those without records too."""
        return self._limits(name)[2]

    def records(self, name: str) -> DataFrame:
        """The records that a stream holds."""
        _, folder, limits = self._limits(name)
        base = limits.select("partition", "base_offset")
        return self.spark.read.parquet(folder).join(base, "partition").filter("offset >= base_offset").drop("base_offset")

    def retain(self, name: str, policy: stream.Retention, now_ms: int) -> DataFrame:
        """Removes what a policy doesn't keep, and returns the bounds after it; the files stay until the stream is compacted."""
        version, folder, limits = self._limits(name)
        after = stream.bounds_after(limits, stream.retained(self.records(name), policy, now_ms))
        self._set_limits(name, version + 1, folder, after)
        return self.bounds(name)

    def compact(self, name: str, transactions: DataFrame, now_ms: int, tombstone_ms: int) -> DataFrame:
        """Writes the records that compaction by key keeps anew, and returns its report; bounds don't move."""
        version, folder, limits = self._limits(name)
        marked = stream.compacted(self.records(name), transactions, now_ms, tombstone_ms).persist()
        after, target = stream.bounds_after(limits, marked, compaction=True), f"{self._folder('stream', name)}/records-{version + 1}"
        report = stream.compaction_report(marked).collect()
        marked.filter("kept").drop("kept").write.parquet(target)
        self._set_limits(name, version + 1, target, after)
        marked.unpersist()
        return self.spark.createDataFrame(report, "partition int, removed long, removed_bytes long, removed_tombstones long")

    def fetch(self, name: str, partition: int, offset: int, limit: int) -> DataFrame:
        """Records of a partition from an offset on."""
        return stream.fetch(self.records(name), stream.known_bounds(self.bounds(name)), partition, offset, limit)

    def poll(self, name: str, partition: int, offset: int, limit: int, wait_ms: int = 1_000) -> list:
        """Records from an offset on, waited for up to ``wait_ms`` (1 to 30,000); none if the time runs out."""
        if not 1 <= wait_ms <= 30_000:
            raise ValueError("a wait is 1 to 30,000 ms")
        end = time.monotonic() + wait_ms / 1_000
        while True:
            found = self.fetch(name, partition, offset, limit).collect() if self._exists(self._limits(name)[1]) else []
            if found or time.monotonic() >= end:
                return found
            time.sleep(min(0.1, max(0.0, end - time.monotonic())))

    def consume(self, name: str) -> DataFrame:
        """A stream's records as they come, for Structured Streaming."""
        folder = self._limits(name)[1]
        return self.spark.readStream.schema(self.spark.read.parquet(folder).schema).parquet(folder)

    def lag(self, name: str, offsets: DataFrame) -> DataFrame:
        """Lag of groups (``group``, ``partition``, ``committed``)."""
        return stream.lag(self.bounds(name), offsets)

    # --- queues, caches and subscriptions

    def apply(self, kind: str, name: str, commands: list[dict]) -> list[dict]:
        """Answers of commands that are applied in order to a queue, cache or bus."""
        folder, make = self._folder(kind, name), _MAKERS[kind]
        fold = make()
        state, version = self.state(kind, name)
        if state is not None:
            fold.load(state)
        answers = [fold.apply(c) for c in commands]
        rows = [(version, k, json.dumps(c), json.dumps(a)) for k, (c, a) in enumerate(zip(commands, answers, strict=True))]
        self.spark.createDataFrame(rows, "version long, seq long, command string, answer string").coalesce(1).write.mode("append").parquet(f"{folder}/log")
        self.spark.createDataFrame([(version + 1, fold.dump())], "version long, state string").coalesce(1).write.mode("append").parquet(f"{folder}/state")
        return answers

    def state(self, kind: str, name: str) -> tuple[str | None, int]:
        """The latest state of a resource and its version."""
        folder = self._folder(kind, name)
        if not self._exists(f"{folder}/state"):
            return None, 0
        row = self.spark.read.parquet(f"{folder}/state").orderBy(F.desc("version")).first()
        return row["state"], row["version"]

    def journal(self, kind: str, name: str, since: int = 0, limit: int = 1_000) -> DataFrame:
        """Commands and answers from a version on."""
        log = self.spark.read.parquet(f"{self._folder(kind, name)}/log")
        return cache.journal(log, since, limit)

    def apply_log(self, kind: str, log: DataFrame) -> DataFrame:
        """Answers of a whole command log (``shard``, ``seq``, ``command``) of many resources, computed on the executors."""
        return drivers.run_batch(log, _MAKERS[kind])

    # --- buses

    def publish(self, name: str, events: DataFrame, subscriptions: list[bus.Subscription]) -> DataFrame:
        """Archives events and returns their routes with what becomes of each."""
        folder = self._folder("bus", name)
        first = self.spark.read.parquet(f"{folder}/archive").count() if self._exists(f"{folder}/archive") else 0
        rows = stream.commit_positions(events).withColumn("position", F.col("commit_position") + first).drop("commit_position").persist()
        rows.count()
        rows.write.mode("append").parquet(f"{folder}/archive")
        return bus.executed(bus.fan_out(rows, subscriptions), self.resources())

    def replay(self, name: str, start_ms: int, end_ms: int, condition: bus.EventFilter | None = None, limit: int = bus.MAX_REPLAY) -> DataFrame:
        """Archived events of a time."""
        return bus.replay(self.spark.read.parquet(f"{self._folder('bus', name)}/archive"), start_ms, end_ms, condition, limit)
