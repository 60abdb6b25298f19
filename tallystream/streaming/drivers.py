"""Runs folds over command logs, in batch and in Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.streaming.folds import Fold

ANSWERS = "shard string, seq long, ok boolean, error string, answer string"
STATES = "shard string, state string"


def _answer(shard: str, seq: int, answer: dict) -> tuple:
    return shard, seq, answer["ok"], answer.get("error"), json.dumps({k: v for k, v in answer.items() if k not in ("ok", "error")}, sort_keys=True, separators=(",", ":"))


def commands(log: DataFrame, shard: str, seq: str, command: str) -> DataFrame:
    """A command log as ``shard``, ``seq`` and ``command``, a JSON object."""
    return log.select(F.col(shard).cast("string").alias("shard"), F.col(seq).cast("bigint").alias("seq"), F.col(command).cast("string").alias("command"))


def _sorted(log: DataFrame) -> DataFrame:
    return log.repartition("shard").sortWithinPartitions("shard", "seq")


def run_batch(log: DataFrame, make: Callable[[], Fold]) -> DataFrame:
    """The answer to every command (``ANSWERS``).

    A shard's commands are streamed in order through one fold, so a task holds
    a shard's state and a batch of commands, never its log.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, fold = None, None
        for batch in batches:
            out = []
            for s, n, c in zip(batch["shard"], batch["seq"], batch["command"], strict=True):
                if fold is None or s != shard:
                    shard, fold = s, make()
                out.append(_answer(s, n, fold.apply(json.loads(c))))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    return _sorted(log).mapInPandas(run, ANSWERS)


def final_states(log: DataFrame, make: Callable[[], Fold]) -> DataFrame:
    """The state of each shard after its log, as JSON (``STATES``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, fold = None, None
        for batch in batches:
            for s, c in zip(batch["shard"], batch["command"], strict=True):
                if fold is None or s != shard:
                    if fold is not None:
                        yield pd.DataFrame([(shard, fold.dump())], columns=["shard", "state"])
                    shard, fold = s, make()
                fold.apply(json.loads(c))
        if fold is not None:
            yield pd.DataFrame([(shard, fold.dump())], columns=["shard", "state"])

    return _sorted(log).mapInPandas(run, STATES)


def run_stream(log: DataFrame, make: Callable[[], Fold]) -> DataFrame:
    """As :func:`run_batch` over a streaming log: the fold's state lives in the state store.

    Commands of a shard must arrive in batches in order of ``seq``; within a
    batch they are sorted.  Time is in the commands, so no timer is needed.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold = make()
        if state.exists:
            fold.load(state.get[0])
        rows = pd.concat(list(parts)).sort_values("seq")
        out = [_answer(key[0], n, fold.apply(json.loads(c))) for n, c in zip(rows["seq"], rows["command"], strict=True)]
        state.update((fold.dump(),))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    return log.groupBy("shard").applyInPandasWithState(run, ANSWERS, "state string", "append", "NoTimeout")
