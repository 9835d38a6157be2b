"""Bounded groups through Python in Arrow batches, many groups per batch.

Spark partitions and sorts; Python sees whole groups as slices of a batch and
keeps at most one unfinished group.  Meant for groups that a chunk already
bounds, where a call per group would cost more than the work in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GroupFn = Callable[[dict[str, list]], dict[str, list]]
RunsFn = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def map_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: RunsFn, schema: str) -> DataFrame:
    """Apply ``fn`` to many whole groups at a time: (columns in order, first row of each group) -> output columns.

    For work that numpy does on all groups of a batch at once.  A group that ends in a later batch waits for it.
    """
    keys, order = list(keys), list(order)
    # Without a number, so that adaptive execution sizes the partitions; a group stays whole.
    sorted_df = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def borders(pdf: pd.DataFrame) -> np.ndarray:
            edge = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                v = pdf[k].to_numpy()
                edge[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(edge)

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            starts = np.concatenate([[0], borders(pdf)])
            return pd.DataFrame(fn({c: pdf[c].to_numpy() for c in pdf.columns}, starts))

        for pdf in batches:
            if pdf.empty:
                continue
            starts = borders(pdf)
            if held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
                starts = np.concatenate([[0], starts])
            if not len(starts):
                held.append(pdf)
                continue
            whole = [*held, pdf.iloc[: starts[-1]]]
            if sum(map(len, whole)):
                yield finish(pd.concat(whole, ignore_index=True))
            held = [pdf.iloc[starts[-1] :]]
        if held:
            yield finish(pd.concat(held, ignore_index=True))

    return sorted_df.mapInPandas(run, schema)


def map_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: GroupFn, schema: str, *, arrays: bool = False
) -> DataFrame:
    """Apply ``fn`` (columns of a group in order -> output columns) to every group.

    Columns come as lists of plain values, or as numpy slices with ``arrays``.
    """

    def each(cols: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, list]:
        out: dict[str, list] = {}
        ends = [*starts[1:].tolist(), len(next(iter(cols.values())))]
        for i, j in zip(starts.tolist(), ends, strict=True):
            for name, values in fn({c: a[i:j] if arrays else a[i:j].tolist() for c, a in cols.items()}).items():
                out.setdefault(name, []).extend(values)
        return out

    return map_runs(df, keys, order, each, schema)
