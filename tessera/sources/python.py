"""Frames from Python, pandas, numpy and Arrow data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def to_spark(spark: SparkSession, data) -> DataFrame:
    """Lists are columns, a list of dicts or tuples is rows; text is read as CSV. Rows are numbered in their order."""
    import pyarrow as pa

    from tessera.frame import unique_names

    if isinstance(data, str):
        from tessera.sources.files import fread

        return fread(text=data).df
    if hasattr(data, "to_frame") and not hasattr(data, "columns"):  # a pandas series
        data = data.to_frame()
    if hasattr(data, "columns") and hasattr(data, "iloc"):
        table = pa.Table.from_pandas(data, preserve_index=False)
    elif isinstance(data, pa.Table):
        table = data
    elif hasattr(data, "dtype"):  # numpy
        columns = [data] if data.ndim == 1 else list(data.T)
        table = pa.table([pa.array(c.filled(None) if hasattr(c, "filled") else c, from_pandas=True) for c in columns], unique_names([None] * len(columns)))
    else:
        if isinstance(data, range):
            data = [list(data)]
        if isinstance(data, list) and data and isinstance(data[0], dict):
            names = list(dict.fromkeys(n for r in data for n in r))
            data = {n: [r.get(n) for r in data] for n in names}
        elif isinstance(data, list) and data and isinstance(data[0], tuple):
            data = {n: list(c) for n, c in zip(getattr(data[0], "_fields", None) or unique_names([None] * len(data[0])), zip(*data, strict=True), strict=True)}
        elif isinstance(data, list):
            columns = data if data and isinstance(data[0], (list, range)) else [data]
            data = {n: list(c) for n, c in zip(unique_names([None] * len(columns)), columns, strict=True)}
        table = pa.table({n: _array(list(c) if isinstance(c, (list, tuple, range)) else [c]) for n, c in data.items()})
    numbered = table.append_column("__rid", pa.array(range(table.num_rows), pa.int64()))
    return spark.createDataFrame(numbered)


def _array(values: list):
    """Whole numbers are 32-bit where they fit."""
    import pyarrow as pa

    known = [x for x in values if x is not None and x == x]
    if known and all(isinstance(x, int) and not isinstance(x, bool) for x in known) and all(abs(x) < 1 << 31 for x in known) and not any(isinstance(x, float) for x in values):
        return pa.array(values, pa.int32())
    if any(isinstance(x, float) for x in known):
        return pa.array([None if x is None or x != x else float(x) for x in values], pa.float64())
    return pa.array([None if x is None or x != x else x for x in values])
