"""Delivery promises of sinks, clocks and commit logs."""

import pytest

from tallystream import extensions
from tallystream.streaming.semantics import Delivery, batch_writer


@pytest.mark.parametrize("delivery, seen", [("at_most_once", 3), ("at_least_once", 5), ("effectively_once", 3), ("transactional", 3)])
def test_batches_that_come_again(spark, tmp_path, delivery, seen):
    write = batch_writer(f"{tmp_path}/target", Delivery(delivery))
    first, second = spark.createDataFrame([(1,), (2,)], "n int"), spark.createDataFrame([(3,)], "n int")
    for batch, number in ((first, 0), (first, 0), (second, 1)):
        write(batch, number)
    found = [r.n for r in spark.read.parquet(f"{tmp_path}/target").collect()]
    assert len(found) == seen and set(found) == {1, 2, 3}


def test_promises_in_a_stream(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    query = source.writeStream.foreachBatch(batch_writer(f"{tmp_path}/out", Delivery.TRANSACTIONAL)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


def test_clocks_and_logs(spark, tmp_path):
    clock = extensions.FixedClock(5)
    clock.advance(3)
    assert clock.now_ms() == 8 and isinstance(clock, extensions.Clock) and isinstance(extensions.SystemClock(), extensions.Clock)
    assert extensions.SystemClock().now_ms() > 1_600_000_000_000
    with pytest.raises(ValueError):
        clock.advance(-1)
    log = extensions.ParquetLog(spark, f"{tmp_path}/log")
    assert isinstance(log, extensions.CommitLog) and log.read(0).collect() == []
    assert log.append(["a", "é"]) == 0 and log.append([]) == 2 and log.append(["c"]) == 2
    assert [tuple(r) for r in log.read(1).collect()] == [(1, "é"), (2, "c")]
    spark.createDataFrame([(3, "changed", 1)], "index long, command string, crc long").write.mode("append").parquet(f"{tmp_path}/log")
    with pytest.raises(Exception, match="damaged"):
        log.read(0).collect()


def test_a_cuckoo_filter_fills_up(spark):
    from tallystream.functions.sketches import CuckooFilter

    cuckoo, held = CuckooFilter(64, 4), []
    for n in range(1_000):
        value = f"v{n}".encode()
        try:
            if cuckoo.add(value):
                held.append(value)
        except OverflowError:
            pass
        assert all(cuckoo.contains(x) for x in held[-300:])
    assert len(held) > 0.95 * 64 * 4 and max(map(len, cuckoo.table)) == 4
