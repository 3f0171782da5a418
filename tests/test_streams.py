"""Streams drained over several batches, with time-outs, restarts and failures, against the batch operators."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import matching, replay
from ledgerloom.streaming.continuous import ReplayGuard, increments, stream_edges
from tests.test_matching import data, frames

LATER = (("Z", "ORDZ", 5, 400, "settlement"), ("Y", 7_000_000, 400, "CR"))


def files(frame, path, parts):
    """Rows as files that arrive one after the other."""
    for number in range(parts):
        frame.filter(F.pmod(F.xxhash64("_row"), F.lit(parts)) == number).drop("_row").coalesce(1).write.mode("append").parquet(path)


def test_edge_stream_with_time_outs(spark, tmp_path):
    """After a drain: every edge of the batch join, and one row for each leg that met no line."""
    legs, lines = frames(spark, *data(23, 40, 18, list(range(10000, 60000, 2900)), 6))
    files(legs.withColumn("_row", F.col("settlement_id")), str(tmp_path / "s"), 3)
    files(lines.withColumn("_row", F.col("bank_txn_id")), str(tmp_path / "b"), 3)
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    edges = stream_edges(read("s", legs.schema), read("b", lines.schema), delay="30 days", unmatched=True)
    sink = str(tmp_path / "out")

    def drain():
        (edges.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", sink)
         .trigger(availableNow=True).start().awaitTermination())
        return sorted(map(tuple, spark.read.parquet(sink).collect()), key=repr)

    drain()
    # a later leg and line move the watermarks past all bands; the query goes on from its checkpoint
    late_leg, late_line = frames(spark, [LATER[0]], [LATER[1]])
    late_leg.write.mode("append").parquet(str(tmp_path / "s"))
    late_line.write.mode("append").parquet(str(tmp_path / "b"))
    got = drain()
    want = [tuple(r) for r in matching.candidate_edges(legs, lines).collect()]
    met = {w[0] for w in want}
    alone = [r.settlement_id for r in matching.leg_pool(legs).collect() if r.settlement_id not in met]
    assert alone and want
    assert got == sorted(want + [(s, None, None, None, None) for s in alone], key=repr)


def feed_of(spark, tmp_path, parts):
    legs, _ = frames(spark, *data(5, 60, 2, [10000, 10100], 4))
    copies = legs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.xxhash64("settlement_id") % 3 == 0, 6).otherwise(1))))
    feed = copies.withColumn("source_row", F.concat("copy", F.lit("/"), "settlement_id"))
    for number in range(parts):
        feed.filter(F.col("copy") % parts == (number + 1) % parts).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return feed, spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))


def compare(guard, spark, feed):
    kept, audit = replay.dedup_events(feed, replay.LEG_EVENT, "settlement_event", "source_row")
    rows = lambda df: sorted((r.event_hash, r.source_row) for r in df.collect())
    assert rows(guard.table(spark, "kept")) == rows(kept)
    replays = guard.table(spark, "replays")
    assert rows(replays) == rows(audit) and replays.filter("reason IS NULL OR entity_type <> 'settlement_event'").count() == 0


def test_replay_guard_equals_the_batch(spark, tmp_path):
    """Copies within a batch and across batches are all recorded, after a restart too."""
    feed, stream = feed_of(spark, tmp_path, 3)
    guard = ReplayGuard(str(tmp_path / "w"), replay.LEG_EVENT, "settlement_event", "source_row", "settlement_date")
    increments(stream, guard, str(tmp_path / "c")).awaitTermination()
    compare(guard, spark, feed)
    more = feed.filter("copy = 1").withColumn("source_row", F.concat(F.lit("9/"), "settlement_id"))
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    increments(stream, guard, str(tmp_path / "c")).awaitTermination()
    compare(guard, spark, feed.unionByName(more))


def test_a_batch_that_dies_is_taken_again(spark, tmp_path):
    feed, stream = feed_of(spark, tmp_path, 2)
    guard = ReplayGuard(str(tmp_path / "w"), replay.LEG_EVENT, "settlement_event", "source_row", "settlement_date")
    calls = []

    def dies(batch, number):
        guard(batch, number)
        calls.append(number)
        if len(calls) == 2:
            raise OSError("driver gone")

    with pytest.raises(Exception, match="driver gone"):
        increments(stream, dies, str(tmp_path / "c")).awaitTermination()
    increments(stream, guard, str(tmp_path / "c")).awaitTermination()
    compare(guard, spark, feed)


def test_a_batch_reads_its_own_days(spark, tmp_path):
    """Fingerprints of other days are not opened."""
    feed, _ = feed_of(spark, tmp_path, 2)
    guard = ReplayGuard(str(tmp_path / "w"), replay.LEG_EVENT, "settlement_event", "source_row", "settlement_date")
    guard(feed, 0)
    day = feed.agg(F.min("settlement_date")).first()[0]
    kept = guard.table(spark, "kept")
    assert len(kept.filter(F.col("event_day").between(day, day)).inputFiles()) <= len(kept.inputFiles())
    plan = kept.filter(F.col("event_day").between(day, day))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_day" in plan
