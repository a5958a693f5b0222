"""Sequential kernels over long series, streamed with bounded memory.

A fold visits the rows of each key in order and carries a small state.  Rows are
partitioned by key and sorted, and each partition is read batch by batch, so a
long series never has to fit in memory, unlike a grouped map.

:func:`fold` starts every key anew.  :func:`resume` goes on from stored states and
returns the states at the end, so that a new day's rows need no old ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]


class Kernel(NamedTuple):
    """A sequential kernel: its first state, and the step over some next rows of a key.

    A state is made of numbers, texts, nulls and lists of these, so that it can be
    stored as JSON (in which doubles keep all their digits).  ``adds`` names the
    columns that a step adds, with their types.
    """

    start: Callable[[], Any]
    step: Step
    adds: str = ""


def chain(*kernels: Kernel) -> Kernel:
    """Several kernels in one pass; each sees the columns that those before add."""

    def step(state: list, rows: pd.DataFrame):
        after = []
        for kernel, own in zip(kernels, state, strict=True):
            own, rows = kernel.step(own, rows)
            after.append(own)
        return after, rows

    return Kernel(lambda: [k.start() for k in kernels], step, ", ".join(k.adds for k in kernels if k.adds))


def _parts(batch: pd.DataFrame, names: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows with one key."""
    changed = np.zeros(len(batch), bool)
    for name in names:
        column = batch[name]
        changed[1:] |= ((column != column.shift()) & ~(column.isna() & column.shift().isna())).to_numpy()[1:]
    edges = [0, *np.flatnonzero(changed).tolist(), len(batch)]
    for lo, hi in zip(edges, edges[1:]):
        if lo < hi:
            rows = batch.iloc[lo:hi]
            yield tuple(None if pd.isna(v) else v for v in rows[names].iloc[0]), rows


#: What stands in a state's row for the columns of data, so that these keep their types.
_FILLED = {"string": "''", "boolean": "false", "date": "DATE '1970-01-01'", "timestamp": "TIMESTAMP '1970-01-01 00:00:00'", "timestamp_ntz": "TIMESTAMP_NTZ '1970-01-01 00:00:00'"}


def resume(df: DataFrame, keys: Sequence[str], order: Sequence[str], kernel: Kernel, before: DataFrame | None = None) -> DataFrame:
    """``df`` with the kernel's columns and ``_state``, going on from ``before``.

    ``before`` has ``keys, _state``: the states of some keys, at most one each;
    others start anew.  The result's rows have a null ``_state``, and for every key
    of either table one more row has the state at its end (and meaningless
    values).  Keys without new rows keep their states.
    """
    names = [k.strip("`") for k in keys]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *([kernel.adds] if kernel.adds else []), "`_state` string"])
    columns = df.columns
    own = df.withColumn("_state", F.lit(None).cast("string"))
    if before is not None:
        value = lambda c, t: F.col(f"`{c}`") if c in names else F.expr(_FILLED.get(t, "0")).cast(t)
        own = own.union(before.select(*[value(c, t).alias(c) for c, t in df.dtypes], "_state"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, blank = None, None, None

        def end() -> pd.DataFrame:
            return blank.assign(**dict(zip(names, last, strict=True)), _state=json.dumps(state))

        for batch in batches:
            out = []
            for key, rows in _parts(batch, names):
                if blank is None or key != last:
                    if blank is not None:
                        out.append(end())
                    last, state = key, kernel.start()
                stored = rows["_state"].notna().to_numpy()
                if stored.any():
                    state = json.loads(rows["_state"].to_numpy()[stored][0])
                state, made = kernel.step(state, rows[~stored].drop(columns="_state"))
                made = made.assign(_state=pd.Series([None] * len(made), index=made.index, dtype=object))
                if blank is None:
                    # One row with every column, whatever is in it.
                    own = {c: rows[c].iloc[:1].to_numpy() for c in columns}
                    blank = pd.DataFrame({c: own.get(c, np.array([None], object)) for c in made.columns})
                if len(made):
                    out.append(made)
            if out:
                yield pd.concat(out, ignore_index=True)
        if blank is not None:
            yield end()

    return own.repartition(*keys).sortWithinPartitions(*keys, F.col("_state").isNull(), *order).mapInPandas(run, schema)


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], Any], step: Step, schema: str) -> DataFrame:
    """Apply ``step(state, rows) -> (state, rows out)`` to consecutive slices.

    ``rows`` are some next rows of one key in order; ``start()`` makes the state
    for a key's first slice.  Rows with equal keys and order keep no set order.
    """
    names = [k.strip("`") for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, begun = None, None, False
        for batch in batches:
            parts = []
            for key, rows in _parts(batch, names):
                if not begun or key != last:
                    last, state, begun = key, start(), True
                state, out = step(state, rows)
                parts.append(out)
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def recursive(column: str, out: str, start: Callable[[], Any], one: Callable[[Any, float], tuple[Any, float | None]]) -> Step:
    """A step that applies ``one(state, value) -> (state, result)`` row by row."""

    def step(state: Any, rows: pd.DataFrame) -> tuple[Any, pd.DataFrame]:
        results = []
        for value in rows[column].to_numpy(dtype=float, na_value=np.nan).tolist():
            state, result = one(state, value)
            results.append(np.nan if result is None else result)
        return state, rows.assign(**{out: pd.array(results, "Float64")})

    return step
