"""Folds, aggregation of frames to exemplars, and models trained by averaged passes.

Training is distributed as passes over partitions: every task improves the current weights on its
own rows, and the tasks' weights, weighted by their rows, are averaged into the next pass. The
weights have a fixed number of bins, so what tasks send does not grow with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import types as t
from tessera.plans.rows import placed_rows, with_positions


def _order(frame):
    return [o.sorted() for o in frame.order or ()]


def kfold(frame, nsplits: int):
    """The frame with ``fold``: contiguous folds ``[i * n // k, (i + 1) * n // k)`` of its rows."""
    from tessera.frame import Frame

    if nsplits < 2:
        raise ValueError("there are at least 2 splits")
    placed, n = placed_rows(frame.df, _order(frame))
    # the fold i of row p is the least with p < (i + 1) * n // k
    fold = F.floor(((F.col("__pos") + 1) * nsplits - 1) / n)
    return Frame(placed.withColumn("fold", fold.cast("int")).drop("__pos"), order=None)


def kfold_random(frame, nsplits: int, seed: int = 0):
    """The frame with ``fold``: folds of the same sizes as :func:`kfold`, of rows in the order of a seeded hash."""
    from tessera.frame import Frame, Order

    placed = with_positions(frame.df, _order(frame)).withColumn("__h", F.xxhash64("__pos", F.lit(seed)))
    return kfold(Frame(placed.drop("__pos").withColumnRenamed("__h", "__rid0"), order=[Order(F.col("__rid0"))]), nsplits)


def _bin(x, low, high, n: int):
    """Equal-width bins; all of one value share bin 0."""
    y = F.floor((x - low) / F.when(high > low, high - low) * (1 - 1e-9) * n)
    return F.when(x.isNotNull(), F.coalesce(F.least(y, F.lit(n - 1)), F.lit(0))).cast("int")


def aggregate(frame, min_rows: int = 0, n_bins: int = 500, nx_bins: int = 50, ny_bins: int = 50, nd_max_bins: int = 500, fixed_radius: float | None = None, seed: int = 0):
    """``(exemplars, members)``: rows gathered by nearness, each exemplar with its ``members_count``.

    One number: equal-width bins; one category: its values; two columns: the grid of both; more:
    cells of a grid over the numbers, scaled to 0..1, as wide as the radius. NA has bins of its
    own. Every row has the ``exemplar_id`` of its cell.
    """
    from tessera.frame import Frame

    fields = frame.fields
    df = frame.df
    numeric = [t.is_number(k) and k != t.BOOL for _, _, k in fields]
    counts = [n_bins] if len(fields) == 1 else [nx_bins, ny_bins] if len(fields) == 2 else [max(2, int(1 / fixed_radius) if fixed_radius else round(nd_max_bins ** (1 / max(1, sum(numeric)))))] * len(fields)
    ranges = [x for n, ok in zip(frame.names, numeric, strict=True) if ok for x in (F.min(F.col(f"`{n}`").cast("double")).alias(f"__lo_{n}"), F.max(F.col(f"`{n}`").cast("double")).alias(f"__hi_{n}"))]
    if ranges:
        df = df.crossJoin(F.broadcast(df.agg(*ranges)))  # one row
    cells = []
    for (n, _, _), ok, bins in zip(fields, numeric, counts, strict=True):
        x = F.col(f"`{n}`")
        cells.append(_bin(x.cast("double"), F.col(f"`__lo_{n}`"), F.col(f"`__hi_{n}`"), bins) if ok else x)
    keyed = df.select(*(F.col(f"`{c}`") for c in frame.df.columns), *(c.alias(f"__cell{k}") for k, c in enumerate(cells)))
    keys = [f"__cell{k}" for k in range(len(cells))]
    picked = [F.first(F.col(f"`{n}`")).alias(n) for n in frame.names]
    groups = keyed.groupBy(*keys).agg(*picked, F.count("*").alias("members_count"))
    if len(fields) == 1 and numeric[0]:
        groups = groups.withColumn("exemplar_id", F.col("__cell0"))
    else:
        groups = with_positions(groups, [F.col(k).asc_nulls_first() for k in keys], "exemplar_id").withColumn("exemplar_id", F.col("exemplar_id").cast("int"))
    condition = F.lit(True)
    for k in keys:
        condition &= keyed[k].eqNullSafe(groups[k])
    members = keyed.join(groups.select(*keys, "exemplar_id"), condition).select(*(keyed[f"`{c}`"] for c in frame.df.columns), "exemplar_id")
    return Frame(groups.drop(*keys)), Frame(members, order=frame.order)


class _Linear:
    """A model of a target by weights over features, trained in passes."""

    def _prepared(self, frame, target: str | None) -> tuple[DataFrame, list]:
        fields = [x for x in frame.fields if x[0] != target]
        columns = [c.alias(f"x{k}") for k, c in enumerate(self._feature(F.col(f"`{n}`"), n, kind) for n, _, kind in fields)]
        if target is None:
            return frame.df.select("*", *columns), fields
        return frame.df.select(*columns, self._encode(F.col(f"`{target}`")).alias("y")).where("y is not null"), fields

    def _encode(self, y):
        if self.kind == "regression":
            return y.cast("double")
        out = F.lit(None).cast("double")
        for k, label in enumerate(self.labels):
            out = F.when(y == F.lit(label), float(k)).otherwise(out)
        return out

    def fit(self, frame, target: str):
        """Train on a frame, one of whose columns is the target."""
        kind = dict((n, k) for n, _, k in frame.fields)[target]
        self.kind = self.model_type if self.model_type != "auto" else "binomial" if kind == t.BOOL else "regression" if t.is_number(kind) else "multinomial"
        if self.kind != "regression":
            most = 1000
            self.labels = [r[0] for r in frame.df.select(F.col(f"`{target}`").alias("y")).where("y is not null").distinct().orderBy("y").limit(most + 1).collect()]
            if len(self.labels) > most:
                raise ValueError(f"the target has over {most} labels")
        self.colnames = [n for n in frame.names if n != target]
        self._start(frame, target)
        rows, _ = self._prepared(frame, target)
        for epoch in range(self.nepochs):
            train = self._trainer(self.state, epoch)
            parts = rows.mapInPandas(train, "n bigint, state binary").collect()  # fixed-size states, one a task
            total = sum(p["n"] for p in parts)
            if total:
                self.state = sum(np.frombuffer(p["state"], np.float64) * (p["n"] / total) for p in parts if p["n"])
        return self

    def is_fitted(self) -> bool:
        return self.state is not None

    def reset(self) -> None:
        self.state, self.labels = None, []

    def predict(self, frame) -> DataFrame:
        """``frame``'s columns and ``prediction``: a probability of the last label, a value, or the likeliest label's number."""
        if not self.is_fitted():
            raise ValueError("the model is not trained")
        rows, _ = self._prepared(frame[:, self.colnames] if set(frame.names) != set(self.colnames) else frame, None)
        visible = [c for c in rows.columns if not c.startswith("__")]
        state, scores, kind, width = self.state, self._scores, self.kind, len(self.colnames)

        def run(batches):
            for batch in batches:
                x = batch[[f"x{k}" for k in range(width)]].to_numpy()
                z = scores(state, x)
                p = z[:, 0] if kind == "regression" else 1 / (1 + np.exp(-np.clip(z[:, -1], -35, 35))) if z.shape[1] <= 2 else z.argmax(axis=1).astype(float)
                yield batch.drop(columns=[f"x{k}" for k in range(width)]).assign(prediction=p)

        kept = rows.select(*(F.col(f"`{c}`") for c in visible))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in self.colnames)
        return kept.mapInPandas(run, f"{schema}, prediction double")


class LinearModel(_Linear):
    """Linear, logistic or one-against-rest regression by stochastic gradients."""

    def __init__(self, eta0: float = 0.005, eta_decay: float = 0.0001, eta_drop_rate: float = 10.0, eta_schedule: str = "constant", lambda1: float = 0.0, lambda2: float = 0.0, nepochs: int = 1, model_type: str = "auto", seed: int = 0):
        self.eta0, self.eta_decay, self.eta_drop_rate, self.eta_schedule = eta0, eta_decay, eta_drop_rate, eta_schedule
        self.lambda1, self.lambda2, self.nepochs, self.model_type, self.seed = lambda1, lambda2, nepochs, model_type, seed
        self.reset()

    def _feature(self, x, name, kind):
        if not t.is_number(kind):
            raise TypeError("a linear model takes numbers")
        return F.coalesce(x.cast("double"), F.lit(0.0))

    def _start(self, frame, target):
        self.width = len(self.colnames) + 1
        self.outputs = 1 if self.kind == "regression" else max(1, len(self.labels))
        if self.state is None:
            self.state = np.zeros(self.width * self.outputs)

    def eta(self, epoch: int) -> float:
        return {
            "constant": lambda: self.eta0,
            "time-based": lambda: self.eta0 / (1 + self.eta_decay * epoch),
            "step-based": lambda: self.eta0 * self.eta_decay ** ((1 + epoch) // self.eta_drop_rate),
            "exponential": lambda: self.eta0 * float(np.exp(-self.eta_decay * epoch)),
        }[self.eta_schedule]()

    def _scores(self, state, x):
        w = state.reshape(self.outputs, self.width)
        return x @ w[:, 1:].T + w[:, 0]

    def _trainer(self, state, epoch):
        eta, l1, l2, kind, outputs, width = self.eta(epoch), self.lambda1, self.lambda2, self.kind, self.outputs, self.width

        def train(batches):
            w, n = state.reshape(outputs, width).copy(), 0
            for batch in batches:
                x = np.hstack([np.ones((len(batch), 1)), batch[[f"x{k}" for k in range(width - 1)]].to_numpy()])
                y = batch["y"].to_numpy()
                for at in range(0, len(batch), 32):
                    xs, ys = x[at : at + 32], y[at : at + 32]
                    z = xs @ w.T
                    want = ys[:, None] if kind == "regression" else (ys[:, None] == np.arange(outputs)[None, :]).astype(float)
                    p = z if kind == "regression" else 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                    w -= eta * ((p - want).T @ xs / len(xs) + l1 * np.sign(w) + l2 * w)
                n += len(batch)
            yield pd.DataFrame({"n": [n], "state": [w.tobytes()]})

        return train


class Ftrl(_Linear):
    """Follow the regularised leader over hashed features."""

    def __init__(self, alpha: float = 0.005, beta: float = 1.0, lambda1: float = 0.0, lambda2: float = 0.0, nbins: int = 1 << 16, mantissa_nbits: int = 10, nepochs: int = 1, interactions=None, model_type: str = "auto"):
        self.alpha, self.beta, self.lambda1, self.lambda2, self.nbins, self.mantissa_nbits = alpha, beta, lambda1, lambda2, nbins, mantissa_nbits
        self.nepochs, self.interactions, self.model_type = nepochs, interactions, model_type
        self.reset()

    def _feature(self, x, name, kind):
        """The bin of a column and its value; numbers are cut to ``mantissa_nbits`` bits."""
        if t.is_float(kind):
            scale = F.pow(F.lit(2.0), F.floor(F.log2(F.when(x != 0, F.abs(x)))) - self.mantissa_nbits)
            x = F.when(x == 0, 0.0).otherwise(F.floor(x / scale) * scale)
        return F.pmod(F.xxhash64(F.lit(name), x.cast("string")), F.lit(self.nbins))

    def _prepared(self, frame, target):
        rows, fields = super()._prepared(frame, target)
        names = [n for n, _, _ in fields]
        for k, group in enumerate(self.interactions or []):
            rows = rows.withColumn(f"x{len(fields) + k}", F.pmod(F.xxhash64(*(F.col(f"x{names.index(g)}") for g in group)), F.lit(self.nbins)))
        return rows, fields

    def _start(self, frame, target):
        self.outputs = 1 if self.kind == "regression" or len(self.labels) <= 2 else len(self.labels)
        if self.state is None:
            self.state = np.zeros(2 * self.nbins * self.outputs)

    def weights(self, state):
        z, n = state.reshape(2, self.outputs, self.nbins)
        return np.where(np.abs(z) <= self.lambda1, 0.0, (np.sign(z) * self.lambda1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.lambda2))

    def _scores(self, state, x):
        w = self.weights(state)
        return np.stack([w[k][x.astype(np.int64)].sum(axis=1) for k in range(self.outputs)], axis=1)

    def _trainer(self, state, epoch):
        alpha, beta, l1, l2, bins, outputs, kind = self.alpha, self.beta, self.lambda1, self.lambda2, self.nbins, self.outputs, self.kind
        one_label = outputs == 1

        def train(batches):
            z, n = state.reshape(2, outputs, bins).copy()
            rows = 0
            for batch in batches:
                x = batch[[c for c in batch.columns if c != "y"]].to_numpy().astype(np.int64)
                for at, y in zip(x, batch["y"].to_numpy(), strict=True):
                    for k in range(outputs):
                        zs, ns = z[k][at], n[k][at]
                        w = np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))
                        s = w.sum()
                        p = s if kind == "regression" else 1 / (1 + np.exp(-min(max(s, -35), 35)))
                        g = p - (y if kind == "regression" or one_label else float(y == k))
                        np.add.at(z[k], at, g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w)
                        np.add.at(n[k], at, g * g)
                rows += len(batch)
            yield pd.DataFrame({"n": [rows], "state": [np.concatenate([z.ravel(), n.ravel()]).tobytes()]})

        return train
