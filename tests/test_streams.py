"""Stateful streams equal batch operators, however ticks are dealt to micro-batches."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import event_backtest, imbalance
from tickloom.operators.sampling import cusum
from tickloom.sources import ticks as S
from tickloom.streaming import ticks as stream

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def run(spark, live, name, folder):
    q = live.writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(folder / name)).start()
    q.awaitTermination(240)
    assert q.exception() is None
    dropped = sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators)
    return spark.table(name).collect(), dropped


def in_files(frame, folder, key, files, kept):
    """One file a micro-batch, rows dealt by ``key``; then a last one that closes the stream by its time."""
    for k in range(files):
        frame.where(key == k).coalesce(1).write.mode("append").parquet(str(folder))
    kept.coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture(scope="module")
def dealt(spark, sf, tmp_path_factory):
    """Half of the events twice as coarse in time, so that times repeat, dealt at random over five micro-batches."""
    folder = tmp_path_factory.mktemp("dealt")
    events = spark.read.parquet(f"{sf}/events.parquet")
    coarse = events.withColumn("ts", F.when(F.col("event_id") % 2 == 0, F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")).otherwise(F.col("ts")))
    coarse.write.parquet(str(folder / "all.parquet"))
    coarse = spark.read.parquet(str(folder / "all.parquet"))
    last = coarse.orderBy("event_id").limit(1).withColumns({"event_type": F.lit("closing"), "ts": F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")})
    in_files(coarse, folder / "in", F.pmod(F.xxhash64("event_id"), F.lit(5)), 5, last)
    (folder / "sf").mkdir()
    coarse.coalesce(1).write.parquet(str(folder / "sf" / "events.parquet"))
    return folder


def live(spark, folder):
    return stream.stream_ticks(spark, str(folder / "in"), files_a_batch=1)


LATE = "4000 days"


def test_cusum_of_dealt_ticks(spark, dealt, tmp_path):
    got, dropped = run(spark, stream.cusum_events(live(spark, dealt), 2.0, late=LATE), "dealt_events", tmp_path)
    t = S.event_ticks(spark, str(dealt / "sf")).withColumn("move", F.log("price") - F.log(F.lag("price").over(Window.partitionBy("symbol").orderBy("ts", "seq"))))
    want = [(r.symbol, r.ts, r.seq, r.event) for r in cusum(t, "move", 2.0, ["symbol"], ["ts", "seq"]).where("event <> 0").collect()]
    assert sorted(map(tuple, got)) == sorted(want) and want and not dropped


def test_volume_bars_of_dealt_ticks(spark, dealt, tmp_path):
    got, dropped = run(spark, stream.volume_bar_ends(live(spark, dealt), 500, late=LATE), "dealt_ends", tmp_path)
    want, day, total = [], {}, {}
    for r in S.event_ticks(spark, str(dealt / "sf")).orderBy("ts", "seq").collect():
        if day.get(r.symbol) != r.ts.date():
            day[r.symbol], total[r.symbol] = r.ts.date(), 0
        before = total[r.symbol]
        total[r.symbol] += r.vol
        if before // 500 != total[r.symbol] // 500:
            want.append((r.symbol, r.ts, total[r.symbol] // 500, total[r.symbol]))
    assert sorted(map(tuple, got)) == sorted(want) and want and not dropped


def test_imbalance_bars_of_dealt_ticks(spark, dealt, tmp_path):
    flows = imbalance.signed_flow(S.event_ticks(spark, str(dealt / "sf")))
    start = spark.createDataFrame(imbalance.expectations(flows).select("symbol", "e_t", "e_flow").collect(), "symbol string, e_t double, e_flow double")
    got, dropped = run(spark, stream.imbalance_bars(live(spark, dealt), start, late=LATE), "dealt_imbalance", tmp_path)
    want = [tuple(r) for r in imbalance.imbalance_bars(flows, start).select("symbol", "ts", "seq", "price", "vol", "bar_id").collect()]
    assert sorted(map(tuple, got)) == sorted(want) and len({w[5] for w in want}) > 3 and not dropped


def test_fills_of_dealt_bars(spark, dealt, tmp_path):
    beats = event_backtest.heartbeats(S.event_ticks(spark, str(dealt / "sf")), "6 hours").select("symbol", "start", "price", F.col("volume").cast("double").alias("volume"))
    last = beats.limit(1).withColumns({"symbol": F.lit("closing"), "start": F.lit("2100-01-01 00:00:00").cast("timestamp")})
    in_files(beats, tmp_path / "beats", F.pmod(F.xxhash64("start", "symbol"), F.lit(4)), 4, last)
    source = spark.readStream.schema(beats.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "beats"))

    def load(text):
        player = event_backtest.Alternating()
        player.periods = json.loads(text)
        return player

    got, dropped = run(spark, stream.portfolio_fills(source, event_backtest.Alternating, lambda p: json.dumps(p.periods), load, late=LATE), "dealt_fills", tmp_path)
    want = [tuple(r) for r in event_backtest.simulate(beats, event_backtest.Alternating).collect()]
    assert sorted(map(tuple, got)) == sorted(want) and want and not dropped


def test_only_rows_behind_the_watermark_are_lost(spark, tmp_path):
    """Out of order within ten minutes: kept.  Behind the watermark: counted, and nothing else is missing."""
    row = lambda i, minute, second=0: (i, f"2024-01-01 10:{minute:02d}:{second:02d}", 1, "a", 10.0, '{"k": 99}')
    batches = [
        [row(1, 5), row(2, 1), row(3, 5)],  # not in order, equal times
        [row(4, 3), row(5, 5), row(6, 20)],  # before and at the times of the last batch
        [row(7, 15)],
        [row(8, 4)],  # comes after the watermark of 10:10 has passed it
        [(9, "2100-01-01 00:00:00", 1, "closing", 1.0, '{"k": 0}')],
    ]
    for rows in batches:
        spark.createDataFrame(rows, EVENTS.replace("ts timestamp_ntz", "ts string")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, dropped = run(spark, stream.volume_bar_ends(live(spark, tmp_path), 100), "late_rows", tmp_path)
    # Seven ticks of 100 in order: each opens a bar.
    assert [(r.ts.minute, r.volume) for r in sorted(got, key=lambda r: r.volume)] == [(1, 100), (3, 200), (5, 300), (5, 400), (5, 500), (15, 600), (20, 700)]
    assert dropped == 1


def test_state_ends_after_idle_time_only_where_asked(spark, tmp_path):
    row = lambda i, day: (i, f"2024-01-{day:02d} 10:00:00", 1, "a", float(10 + i), '{"k": 0}')
    other = lambda day: (90 + day, f"2024-01-{day:02d} 12:00:00", 1, "b", 1.0, '{"k": 0}')
    for rows in ([row(1, 1), row(2, 1)], [other(20)], [other(21)], [row(3, 22)], [(99, "2100-01-01 00:00:00", 1, "closing", 1.0, '{"k": 0}')]):
        spark.createDataFrame(rows, EVENTS.replace("ts timestamp_ntz", "ts string")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept, _ = run(spark, stream.cusum_events(live(spark, tmp_path), 0.05), "kept_state", tmp_path)
    gone, _ = run(spark, stream.cusum_events(live(spark, tmp_path), 0.05, idle="5 days"), "idle_state", tmp_path)
    assert [r.seq for r in sorted(kept, key=lambda r: r.seq)] == [2, 3] and [r.seq for r in gone] == [2]
