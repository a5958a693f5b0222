"""The dataset pipeline: ticks to labelled, weighted feature bars in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import ratio
from tickloom.operators import bars, features, labels, sampling, volatility, weights
from tickloom.sources.tables import StageStore

VOLATILITIES = {"lagged": volatility.daily_lagged, "open_close": volatility.daily_open_close, "intraday": volatility.daily_intraday}


@dataclass(frozen=True)
class Settings:
    """Parameters of all stages."""

    kind: str = "volume"
    bars_a_day: int = 10
    volatility: str = "open_close"
    horizon_days: int = 1
    cusum: float = 1.0
    #: "sadf": the filter runs over the bars whose statistic is not negative; "returns": over all.
    sample_on: str = "sadf"
    #: Lagged changes in the regressions; None: chosen by the information criterion.
    sadf_lags: int | None = None
    #: The most bars of a regression; None: from the first bar on.
    sadf_longest: int | None = None
    decay: float = 0.5
    fracdiff_order: float = 0.4
    sampled_only: bool = False


def make_bars(ticks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Calibrated bars with volatility, barriers and fractional differences."""
    made = bars.calibrated_bars(ticks, s.kind, s.bars_a_day)
    made = made.withColumn("bar", F.row_number().over(Window.partitionBy("symbol").orderBy("date", "bar_id")).cast("long"))
    barred = volatility.with_barriers(made, VOLATILITIES[s.volatility](ticks), s.horizon_days)
    return sampling.fracdiff(barred, "close_price", s.fracdiff_order, 2, ["symbol"], ["bar"])


def make_samples(made: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Bars with the explosiveness statistic and the sampled events of it."""
    tested = sampling.sadf(made, "close_price", ["symbol"], ["bar"], lags=s.sadf_lags, longest=s.sadf_longest)
    move = F.log(ratio(F.col("close_price"), F.lag("close_price").over(Window.partitionBy("symbol").orderBy("bar"))))
    tested = tested.withColumn("_move", F.coalesce(move, F.lit(0.0)))
    eligible = tested.where("sadf >= 0") if s.sample_on == "sadf" else tested
    fired = sampling.sampled(eligible, "_move", s.cusum, ["symbol"], ["bar"]).select("symbol", "bar", "event")
    marked = tested.drop("_move").join(fired, ["symbol", "bar"], "left").withColumn("event", F.coalesce("event", F.lit(0)))
    return marked.where("event <> 0") if s.sampled_only else marked


def make_labels(made: DataFrame, ticks: DataFrame) -> DataFrame:
    return made.join(labels.triple_barrier(made, ticks), ["symbol", "bar"])


def make_weights(labelled: DataFrame, s: Settings = Settings()) -> DataFrame:
    return weights.time_decay(weights.attribution(weights.overlap(labelled)), s.decay)


def dataset(ticks: DataFrame, s: Settings = Settings(), store: StageStore | None = None) -> DataFrame:
    """All stages; with a store each is written once and the next reads it."""

    def stage(name: str, df: DataFrame) -> DataFrame:
        if store is None:
            return df
        if not store.exists(name):
            store.create(name, df)
        return store.read(name)

    stage("tuning", bars.calibrate(ticks, s.bars_a_day))
    made = stage("bars", make_bars(ticks, s))
    sampled = stage("sampled", make_samples(made, s))
    labelled = stage("labelled", make_labels(sampled, ticks))
    weighted = stage("weighted", make_weights(labelled, s))
    return stage("features", features.assemble(weighted, complete=False))
