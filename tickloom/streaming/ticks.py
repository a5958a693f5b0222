"""Structured Streaming twins: time bars, CUSUM events, volume and imbalance bars, a running portfolio.

Time and session bars are aggregations.  The others are folds over each symbol's
ticks in order: :class:`Ordered` holds ticks back until the watermark passes
them, so that results equal those of the batch operators row for row, however
ticks are dealt to files and micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.exprs import ratio
from tickloom.operators import imbalance
from tickloom.operators.event_backtest import Strategy, order_quantity


def stream_ticks(spark: SparkSession, folder: str, symbol: str = "event_type", files_a_batch: int = 10) -> DataFrame:
    """The event files of a folder as a stream of ticks."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return read.select(F.col(symbol).cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("long") + 1).alias("vol"))


def time_bars(ticks: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Bars over event-time windows; ticks later than ``late`` are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    at = F.struct("ts", "seq")
    return ticks.withWatermark("ts", late).groupBy("symbol", window.alias("w")).agg(
        F.count("*").alias("n_ticks"), F.min_by("price", at).alias("open_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"), F.max_by("price", at).alias("close_price"),
        F.sum("vol").alias("volume"), ratio(F.sum(F.col("price") * F.col("vol")), F.sum("vol"), 0.0).alias("vwap"),
    ).select("symbol", F.col("w.start").alias("start"), "n_ticks", "open_price", "high_price", "low_price", "close_price", "volume", "vwap")


def session_bars(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars over bursts of ticks less than ``gap`` apart."""
    return ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_ticks"), F.sum("vol").alias("volume")).select("symbol", F.col("w.start").alias("start"), "n_ticks", "volume")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Step = Callable[[tuple, pd.DataFrame, tuple], tuple[tuple, list]]


class Ordered(StatefulProcessor):
    """Holds each symbol's rows until the watermark has passed them, then plays them in order.

    What waits is a list state; an event-time timer is set for its first row.  When
    it fires, no row that Spark still lets in can come before those played, so
    they are taken in their one order however they were dealt to micro-batches.
    Rows of equal time are played together.
    """

    def __init__(self, time: str, columns: list[tuple[str, str]], order: list[str], names: list[str], start: Callable[[], tuple], step: Step, state_schema: str, idle_ms: int | None):
        self.time, self.columns, self.order, self.names = time, columns, order, names
        self.start, self.step, self.state_schema, self.idle_ms = start, step, state_schema, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"`{c}` {'long' if c == self.time else kind}" for c, kind in self.columns))
        self.kept = handle.getValueState("kept", f"timer long, at long, {self.state_schema}")

    def _kept(self) -> tuple:
        return tuple(self.kept.get()) if self.kept.exists() else (None, None, *self.start())

    def _wake(self, kept: tuple, at_ms: int) -> None:
        """Be called when the watermark reaches ``at_ms``, and keep the state."""
        timer, *rest = kept
        if timer is None or at_ms < timer:
            self.handle.registerTimer(at_ms)
            timer = at_ms
        self.kept.update((timer, *rest))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            own = frame[[c for c, _ in self.columns]].copy()
            own[self.time] = own[self.time].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([tuple(None if pd.isna(v) else v for v in r) for r in own.astype(object).itertuples(index=False)])
            first = min(own[self.time].min(), first if first is not None else own[self.time].min())
        if first is not None:
            self._wake(self._kept(), -int(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        place = [c for c, _ in self.columns].index(self.time)
        rows = list(self.waiting.get())
        due, later = [r for r in rows if r[place] <= now * 1000], [r for r in rows if r[place] > now * 1000]
        _, at, *inner = self._kept()
        if not due:
            if not rows and at is not None and self.idle_ms is not None and at // 1000 + self.idle_ms <= now:
                self.kept.clear()
            return iter([])
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        played = pd.DataFrame([tuple(r) for r in due], columns=[c for c, _ in self.columns]).sort_values(self.order, kind="stable")
        at = int(played[self.time].iloc[-1])
        played[self.time] = pd.to_datetime(played[self.time], unit="us")
        inner, out = self.step(tuple(key), played, tuple(inner))
        kept = (None, at, *inner)
        if later:
            self._wake(kept, -(-min(r[place] for r in later) // 1000))
        elif self.idle_ms is not None:
            self._wake(kept, at // 1000 + self.idle_ms)
        else:
            self.kept.update(kept)
        return iter([pd.DataFrame(out, columns=self.names)] if out else [])

    def close(self) -> None:
        pass


def _by_symbol(rows: DataFrame, time: str, order: list[str], start: Callable[[], tuple], step: Step, schema: str, state_schema: str, late: str | None, idle: str | None) -> DataFrame:
    """A stateful pass over each symbol's rows in order, whatever order they come in.

    A row waits until the watermark, which is ``late`` behind the newest row of
    any symbol, has passed it.  Only rows that come behind the watermark are lost;
    the query's progress counts them (``numRowsDroppedByWatermark``).  With ``idle``
    a symbol without rows for so much event time loses its state and starts anew
    when it comes back; without, states are kept.  The session is set to keep
    state in RocksDB, which timers and list states need.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [c.split()[0] for c in schema.split(", ")]
    columns = [(c, kind) for c, kind in rows.dtypes if c != "symbol"]
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    player = Ordered(time, columns, order, names, start, step, state_schema, idle_ms)
    marked = rows.withWatermark(time, late) if late else rows  # None: it has its watermark
    return marked.groupBy("symbol").transformWithStateInPandas(player, schema, "Append", "EventTime")


def cusum_events(ticks: DataFrame, h: float, late: str = "10 minutes", idle: str | None = None) -> DataFrame:
    """``symbol, ts, seq, event`` where the CUSUM filter of log price moves fires.

    The state of a symbol is its two sums and last price.
    """
    import math

    def step(key: tuple, rows: pd.DataFrame, state: tuple) -> tuple[tuple, list]:
        up, down, last = state
        out = []
        for ts, seq, price in rows[["ts", "seq", "price"]].itertuples(index=False):
            if last > 0:
                move = math.log(price / last)
                up, down = max(0.0, up + move), min(0.0, down + move)
                if down < -h:
                    out.append((key[0], ts, seq, -1))
                    down = 0.0
                elif up > h:
                    out.append((key[0], ts, seq, 1))
                    up = 0.0
            last = price
        return (up, down, last), out

    return _by_symbol(ticks.select("symbol", "ts", "seq", "price"), "ts", ["ts", "seq"], lambda: (0.0, 0.0, -1.0), step, "symbol string, ts timestamp, seq long, event int", "up double, down double, last double", late, idle)


def volume_bar_ends(ticks: DataFrame, threshold: float, late: str = "10 minutes", idle: str | None = None) -> DataFrame:
    """``symbol, ts, bar_id, volume``: a row whenever a symbol's day opens a new volume bar.

    ``ts`` is the tick that opens it and ``volume`` the day's volume so far.
    """

    def step(key: tuple, rows: pd.DataFrame, state: tuple) -> tuple[tuple, list]:
        day, volume = state
        out = []
        for ts, vol in rows[["ts", "vol"]].itertuples(index=False):
            if str(ts.date()) != day:
                day, volume = str(ts.date()), 0
            before, volume = volume, volume + int(vol)
            if before // threshold != volume // threshold:
                out.append((key[0], ts, int(volume // threshold), volume))
        return (day, volume), out

    return _by_symbol(ticks.select("symbol", "ts", "seq", "vol"), "ts", ["ts", "seq"], lambda: ("", 0), step, "symbol string, ts timestamp, bar_id long, volume long", "day string, volume long", late, idle)


def imbalance_bars(ticks: DataFrame, start: DataFrame, kind: str = "volume", alpha_t: float = 0.1, alpha_flow: float = 0.1, late: str = "10 minutes", idle: str | None = None) -> DataFrame:
    """``symbol, ts, seq, price, vol, bar_id`` as :func:`tickloom.operators.imbalance.imbalance_bars`.

    ``start`` has each symbol's first expectations (``symbol, e_t, e_flow``, a
    table); ticks of other symbols are left out, as are those before the first move.
    """
    # The watermark follows all ticks, also those of symbols that the join leaves out.
    rows = ticks.withWatermark("ts", late).withColumn("size", imbalance.size_of(kind)).join(start.select("symbol", "e_t", "e_flow"), "symbol").select("symbol", "ts", "seq", "price", "vol", "size", "e_t", "e_flow")
    kernel = imbalance.kernel(alpha_t, alpha_flow)

    def step(key: tuple, rows: pd.DataFrame, state: tuple) -> tuple[tuple, list]:
        after, made = kernel.step(list(state), rows)
        made = made[made["bar_id"].notna()]
        return tuple(after), [(key[0], *r) for r in made[["ts", "seq", "price", "vol", "bar_id"]].itertuples(index=False)]

    schema = "symbol string, ts timestamp, seq long, price double, vol long, bar_id long"
    state = "last double, sign double, theta double, n long, bar long, e_t double, e_flow double"
    return _by_symbol(rows, "ts", ["ts", "seq"], lambda: tuple(kernel.start()), step, schema, state, None, idle)


def portfolio_fills(bars: DataFrame, strategy: Callable[[], Strategy], dump: Callable[[Strategy], str], load: Callable[[str], Strategy], lot: int = 100, late: str = "10 minutes", idle: str | None = None) -> DataFrame:
    """Fills of a strategy over a stream of bars ``symbol, start, price, volume``.

    The strategy's own state is kept as text by ``dump`` and ``load``.
    """

    def step(key: tuple, rows: pd.DataFrame, state: tuple) -> tuple[tuple, list]:
        said_before, position = state
        player = load(said_before) if said_before else strategy()
        out = []
        for start, price, volume in rows[["start", "price", "volume"]].itertuples(index=False):
            said = player.on_bar(start, price, volume)
            quantity = order_quantity(said[0], said[1], position, lot) if said else 0
            if quantity:
                position += quantity
                out.append((key[0], start, price, said[0], quantity))
        return (dump(player), position), out

    return _by_symbol(bars.select("symbol", "start", "price", "volume"), "start", ["start"], lambda: ("", 0), step, "symbol string, start timestamp, price double, signal string, quantity long", "player string, position long", late, idle)


def to_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Write what is there, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
