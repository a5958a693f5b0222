"""Stages that go on from yesterday: a new day's ticks, and no old ones.

Each stage is one table, in parts by day: a day's rows, and the states of all
symbols at its end.  A new day reads its own ticks and the states of the last day
before it, so its cost does not grow with the history.  Doing a day again, or
several at once, gives the same rows; a day that is done again is written over,
and those after it are then to be done again, too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scan
from tickloom.functions.exprs import ratio
from tickloom.functions.fold import Kernel, chain, resume
from tickloom.operators import bars, imbalance
from tickloom.sources.tables import StageStore, read_ticks


@dataclass(frozen=True)
class Rules:
    """Fixed parameters of the daily stages; thresholds are not calibrated anew each day."""

    kind: str = "volume"
    threshold: float = 500
    span: float = 100
    cusum: float = 1.0
    fracdiff_order: float = 0.4
    flow: str = "volume"
    alpha_t: float = 0.1
    alpha_flow: float = 0.1


def numbering(out: str = "bar") -> Kernel:
    """Rows numbered from 1."""
    return Kernel(lambda: 0, lambda n, rows: (n + len(rows), rows.assign(**{out: np.arange(n + 1, n + 1 + len(rows), dtype=np.int64)})), f"`{out}` long")


def lagged(value: str, out: str) -> Kernel:
    """The value of the row before; null on the first."""

    def step(last, rows: pd.DataFrame):
        x = rows[value].to_numpy(float)
        before = np.r_[np.nan if last is None else last, x[:-1]][: len(x)]
        return (float(x[-1]) if len(x) else last), rows.assign(**{out: pd.array(before, "Float64")})

    return Kernel(lambda: None, step, f"`{out}` double")


def fractional(value: str, before: str, d: float, out: str = "fracdiff") -> Kernel:
    """The fractional difference of window two; 0 on the first row."""
    return Kernel(lambda: 0, lambda s, rows: (s, rows.assign(**{out: (rows[value] - d * rows[before].astype("Float64")).fillna(0.0)})), f"`{out}` double")


def log_moves(value: str, before: str, out: str = "move") -> Kernel:
    """The log return; 0 on the first row."""
    return Kernel(lambda: 0, lambda s, rows: (s, rows.assign(**{out: np.nan_to_num(np.log(rows[value].to_numpy(float) / rows[before].to_numpy(dtype=float, na_value=np.nan)))})), f"`{out}` double")


class DailyStages:
    """``daily_bars``, ``daily_volatility`` and ``daily_imbalance`` in a store."""

    def __init__(self, store: StageStore, rules: Rules = Rules(), expectations: DataFrame | None = None):
        """``expectations``: ``symbol, e_t, e_flow`` for the imbalance bars, which are left out without."""
        self.store, self.rules, self.expectations = store, rules, expectations

    def _states(self, stage: str, first: str) -> DataFrame | None:
        """The states at the end of the last day before ``first``: one small part of the table."""
        if not self.store.exists(stage):
            return None
        parts = [r[0] for r in self.store.spark.sql(f"SHOW PARTITIONS {self.store.name(stage)}").collect()]
        days = [p.split("/")[0].removeprefix("date=") for p in parts if p.endswith("part=states")]
        last = max((d for d in days if d < first), default=None)
        if last is None:
            return None
        # By its folder: a table that is read cannot be written to.
        told = self.store.spark.sql(f"DESCRIBE FORMATTED {self.store.name(stage)} PARTITION (date = '{last}', part = 'states')").where("col_name = 'Location'").first()
        return self.store.spark.read.parquet(told["data_type"]).select("symbol", "_state")

    def step(self, stage: str, rows: DataFrame, order: Sequence[str], kernel: Kernel, first: str, last: str) -> DataFrame:
        """The stage's rows of the days ``first`` to ``last``, and states, as they are to be written."""
        done = resume(rows, ["symbol"], order, kernel, self._states(stage, first))
        state = F.col("_state").isNotNull()
        return done.withColumns({"date": F.when(state, F.lit(last).cast("date")).otherwise(F.col("date")), "part": F.when(state, "states").otherwise("rows")})

    def _write(self, stage: str, df: DataFrame) -> None:
        if self.store.exists(stage):
            self.store.replace_days(stage, df)
        else:
            self.store.create(stage, df, partition_by=("date", "part"))

    def stages(self, folder: str, first: str, last: str | None = None) -> dict[str, DataFrame]:
        """What :meth:`advance` writes, by stage."""
        r, last = self.rules, last or first
        ticks = read_ticks(self.store.spark, folder, first, last)
        at = F.struct("ts", "seq")
        made = bars.bars(ticks, r.kind, r.threshold)
        kernel = chain(numbering(), lagged("close_price", "last_close"), fractional("close_price", "last_close", r.fracdiff_order), log_moves("close_price", "last_close"), scan.cusum("move", r.cusum).kernel)
        days = ticks.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.min_by("price", at).alias("a"), F.max_by("price", at).alias("b"))
        returns = days.select("symbol", "date", (ratio(F.col("b"), F.col("a")) - 1).alias("ret"))
        out = {
            "daily_bars": self.step("daily_bars", made, ["date", "bar_id"], kernel, first, last),
            "daily_volatility": self.step("daily_volatility", returns, ["date"], scan.ewm_std("ret", r.span, "volatility").kernel, first, last),
        }
        if self.expectations is not None:
            flows = ticks.withColumn("date", F.to_date("ts")).withColumn("size", imbalance.size_of(r.flow)).join(self.expectations.select("symbol", "e_t", "e_flow"), "symbol")
            out["daily_imbalance"] = self.step("daily_imbalance", flows, ["ts", "seq"], imbalance.kernel(r.alpha_t, r.alpha_flow), first, last)
        return out

    def advance(self, folder: str, first: str, last: str | None = None) -> None:
        """Do the days ``first`` to ``last`` (default: ``first`` alone) of the ticks in ``folder``.

        Days that have no ticks write no rows; symbols without ticks keep their states.
        """
        for stage, df in self.stages(folder, first, last).items():
            self._write(stage, df)

    def rows(self, stage: str) -> DataFrame:
        """The rows of all days done."""
        return self.store.read(stage).where("part = 'rows'").drop("part", "_state")
