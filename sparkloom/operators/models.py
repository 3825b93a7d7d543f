"""Models as scoring expressions, fitted by one aggregate for each step.

Weights are small and literal in the expressions; every row is scored in one projection.
Cells that carry a state along a sequence fold over an array with ``aggregate``, or, for
sequences too long to hold as one row, stream sorted rows through an Arrow batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.activation import sigmoid, softmax, softplus
from sparkloom.functions.ieee import dbl
from sparkloom.functions.random import keyed_uniform
from sparkloom.functions.vector import dot
from sparkloom.operators.features import quantiles
from sparkloom.operators.linalg import gram, linear


def dense(columns: list[str], weights: np.ndarray, bias: np.ndarray, prefix: str = "y") -> dict[str, Column]:
    """``y = x W + b`` with W of (columns x outputs)."""
    return {f"{prefix}_{j}": linear(columns, weights[:, j], bias[j]) for j in range(weights.shape[1])}


@dataclass
class RBM:
    """A restricted Boltzmann machine over named columns in [0, 1]."""

    columns: list[str]
    weights: np.ndarray
    visible: np.ndarray
    hidden: np.ndarray
    threshold: float = 1.0

    def hidden_exprs(self) -> list[Column]:
        return [sigmoid(linear(self.columns, self.weights[:, j], self.hidden[j])) for j in range(len(self.hidden))]

    def with_hidden(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"h_{j}": e for j, e in enumerate(self.hidden_exprs())})

    def reconstruct(self, df: DataFrame) -> DataFrame:
        """Adds ``h_j`` and ``r_column``."""
        hs = [f"h_{j}" for j in range(len(self.hidden))]
        return self.with_hidden(df).withColumns({f"r_{c}": sigmoid(linear(hs, self.weights[i], self.visible[i])) for i, c in enumerate(self.columns)})

    def reconstruction_error(self, df: DataFrame, name: str = "error") -> DataFrame:
        out = self.reconstruct(df)
        e = sum(((dbl(F.col(c)) - F.col(f"r_{c}")) * (dbl(F.col(c)) - F.col(f"r_{c}")) for c in self.columns), F.lit(0.0))
        return out.withColumn(name, e).drop(*[f"h_{j}" for j in range(len(self.hidden))], *[f"r_{c}" for c in self.columns])

    def free_energy(self) -> Column:
        pulled = sum((softplus(linear(self.columns, self.weights[:, j], self.hidden[j])) for j in range(len(self.hidden))), F.lit(0.0))
        return -(pulled + linear(self.columns, self.visible))

    def sample_hidden(self, df: DataFrame, key: Column, seed: int = 0) -> DataFrame:
        """Adds ``s_j``, 0 or 1 by each hidden unit's probability; the same for the same key."""
        return df.withColumns({f"s_{j}": (e > keyed_uniform(key, seed + j)).cast("double") for j, e in enumerate(self.hidden_exprs())})

    def sample_visible(self, df: DataFrame, key: Column, seed: int = 0) -> DataFrame:
        """Adds ``v_column``, 0 or 1 by the probability that the states ``s_j`` give; the same for the same key."""
        hs = [f"s_{j}" for j in range(len(self.hidden))]
        return df.withColumns({f"v_{c}": (sigmoid(linear(hs, self.weights[i], self.visible[i])) > keyed_uniform(key, seed + 1000 + i)).cast("double") for i, c in enumerate(self.columns)})

    def is_anomaly(self, df: DataFrame, method: str = "reconstruction", threshold: float | None = None) -> DataFrame:
        """Adds ``anomaly``: an error above the threshold (1), or a negative free energy below it (0)."""
        if method == "reconstruction":
            return self.reconstruction_error(df, "__e").withColumn("anomaly", F.col("__e") > (1.0 if threshold is None else threshold)).drop("__e")
        return df.withColumn("anomaly", -self.free_energy() < (0.0 if threshold is None else threshold))

    def detect(self, df: DataFrame) -> DataFrame:
        """Adds ``error`` and ``anomaly`` (an error above the threshold)."""
        return self.reconstruction_error(df).withColumn("anomaly", F.col("error") > self.threshold)


def _divergence_step(m: RBM, rows: DataFrame, steps: int) -> np.ndarray:
    """Mean products and values of the data less those after ``steps`` rounds of mean-field states: one aggregate."""
    columns, hidden = m.columns, len(m.hidden)
    hs = [f"h_{j}" for j in range(hidden)]
    out, seen = m.with_hidden(rows), hs
    for k in range(steps):
        back = {f"r{k}_{c}": sigmoid(linear(seen, m.weights[i], m.visible[i])) for i, c in enumerate(columns)}
        again = [f"g{k}_{j}" for j in range(hidden)]
        out = out.withColumns(back).withColumns({g: sigmoid(linear(list(back), m.weights[:, j], m.hidden[j])) for j, g in enumerate(again)})
        seen, made = again, list(back)
    cells = [F.avg(F.col(c) * F.col(h) - F.col(r) * F.col(g)) for c, r in zip(columns, made) for h, g in zip(hs, seen)]
    got = out.agg(*cells, *[F.avg(F.col(c) - F.col(r)) for c, r in zip(columns, made)], *[F.avg(F.col(h) - F.col(g)) for h, g in zip(hs, seen)]).first()
    return np.array([x or 0.0 for x in got])


def train_rbm(
    df: DataFrame, columns: list[str], hidden: int = 4, epochs: int = 5, rate: float = 0.1, seed: int = 0, percentile: float = 0.95,
    steps: int = 1, momentum: float = 0.0, decay: float = 0.0, validation: DataFrame | None = None, patience: int = 5,
) -> RBM:
    """Full-batch contrastive divergence with mean-field states: one aggregate for each epoch.

    With ``validation`` rows training ends once their mean error has not fallen for ``patience`` epochs.
    """
    rng, d = np.random.default_rng(seed), len(columns)
    m = RBM(columns, rng.normal(scale=0.1, size=(d, hidden)), np.zeros(d), np.zeros(hidden))
    rows = df.select(*[dbl(F.col(c)).alias(c) for c in columns])
    speed, best, waited = np.zeros(d * hidden + d + hidden), math.inf, 0
    for _ in range(epochs):
        speed = momentum * speed + _divergence_step(m, rows, steps)
        m.weights = m.weights + rate * (speed[: d * hidden].reshape(d, hidden) - decay * m.weights)
        m.visible, m.hidden = m.visible + rate * speed[d * hidden : d * hidden + d], m.hidden + rate * speed[d * hidden + d :]
        if validation is not None:
            error = m.reconstruction_error(validation).agg(F.avg("error")).first()[0]
            waited, best = (0, error) if error is not None and error < best else (waited + 1, best)
            if waited >= patience:
                break
    m.threshold = quantiles(m.reconstruction_error(rows).select("error"), "error", [percentile])[0] or 0.0
    return m


@dataclass
class Detector:
    """Anomaly scores of a machine over scaled columns, with a threshold from the data it was fitted on."""

    machine: RBM
    scaling: dict[str, tuple[float, float]]
    method: str
    threshold: float
    mean: float
    std: float

    def scaled(self, df: DataFrame) -> DataFrame:
        """Adds the scaled columns under the machine's names."""
        return df.withColumns({n: (dbl(F.col(c)) - shift) / size for n, (c, (shift, size)) in zip(self.machine.columns, self.scaling.items())})

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``score``: the reconstruction error, or the negative free energy."""
        rows = self.scaled(df)
        out = self.machine.reconstruction_error(rows, "score") if self.method == "reconstruction" else rows.withColumn("score", -self.machine.free_energy())
        return out.drop(*self.machine.columns)

    def reconstruct(self, df: DataFrame) -> DataFrame:
        """Adds ``r_column``, what the machine makes of each column, in the column's own scale."""
        out = self.machine.reconstruct(self.scaled(df))
        back = {f"r_{c}": F.col(f"r_{n}") * size + shift for n, (c, (shift, size)) in zip(self.machine.columns, self.scaling.items())}
        return out.withColumns(back).drop(*[f"r_{n}" for n in self.machine.columns], *[f"h_{j}" for j in range(len(self.machine.hidden))], *self.machine.columns)

    def detect(self, df: DataFrame) -> DataFrame:
        """Adds ``score``, ``anomaly`` (over the threshold) and ``probability``, the sigmoid of the standardised score."""
        return self.score(df).withColumn("anomaly", F.col("score") > self.threshold).withColumn("probability", sigmoid((F.col("score") - self.mean) / (self.std or 1.0)))


def fit_detector(df: DataFrame, columns: list[str], hidden: int = 4, scaling: str = "standard", method: str = "reconstruction", percentile: float = 0.95, validation: DataFrame | None = None, **training) -> Detector:
    """Scale (``standard`` or ``minmax``), train, and take the threshold and the scores' moments from ``df``."""
    x = [dbl(F.col(c)) for c in columns]
    if scaling == "standard":
        row = df.agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
        sizes = [(row[i] or 0.0, row[len(x) + i] or 1.0) for i in range(len(x))]
    else:
        row = df.agg(*[F.min(c) for c in x], *[F.max(c) for c in x]).first()
        sizes = [(row[i] or 0.0, (row[len(x) + i] or 0.0) - (row[i] or 0.0) or 1e-8) for i in range(len(x))]
    names = [f"__x{i}" for i in range(len(columns))]
    out = Detector(RBM(names, np.zeros((len(x), hidden)), np.zeros(len(x)), np.zeros(hidden)), dict(zip(columns, sizes)), method, 0.0, 0.0, 1.0)
    held = out.scaled(validation).select(*names) if validation is not None else None
    out.machine = train_rbm(out.scaled(df), names, hidden, percentile=percentile, validation=held, **training)
    scores = out.score(df).select("score")
    out.mean, out.std = (v or 0.0 for v in scores.agg(F.avg("score"), F.stddev_pop("score")).first())
    out.threshold = quantiles(scores, "score", [percentile])[0] or 0.0
    return out


def expectation_solver(df: DataFrame, xs: list[str], y: str, ridge: float = 1e-6) -> np.ndarray:
    """Slopes -P_xy / P_yy from the inverse P of the ridged covariance matrix."""
    n, s, g = gram(df, [*xs, y])
    cov = (g - np.outer(s, s) / n) / (n - 1) + ridge * np.eye(len(xs) + 1)
    p = np.linalg.inv(cov)
    return -p[:-1, -1] / p[-1, -1]


# Sequences in an array column


def leaky_fold(xs: Column, tau: float = 1.0, dt: float = 1.0, weight: float = 1.0) -> Column:
    """States of h' = h exp(-dt / tau) + (1 - exp(-dt / tau)) tanh(weight x), from 0, as an array."""
    keep = math.exp(-dt / tau)
    start = F.array().cast("array<double>")
    return F.aggregate(xs, start, lambda hs, x: F.array_append(hs, F.coalesce(F.try_element_at(hs, F.lit(-1)), F.lit(0.0)) * keep + (1 - keep) * F.tanh(weight * dbl(x))))


def last_state(xs: Column, tau: float = 1.0, dt: float = 1.0, weight: float = 1.0) -> Column:
    keep = math.exp(-dt / tau)
    return F.aggregate(xs, F.lit(0.0), lambda h, x: h * keep + (1 - keep) * F.tanh(weight * dbl(x)))


def leaky_state(df: DataFrame, key: list[str], block: list[str], order: list[str], x: Column, tau: float = 1.0, dt: float = 1.0) -> DataFrame:
    """``key`` and ``state``, the last state of the leaky fold over each key's rows.

    The state is a sum of (1 - d) d^(rows after) tanh(x) with d = exp(-dt / tau).  Rows after
    are counted in two levels: inside a ``block`` (columns that come first in the order, such
    as the day) and over the blocks that follow, so no key's rows meet in one task.
    """
    d = math.exp(-dt / tau)
    within = Window.partitionBy(*key, *block).orderBy(*[F.desc(c) for c in order])
    part = df.select(*key, *block, *[c for c in order if c not in block], F.tanh(dbl(x)).alias("__x")).withColumn("__after", F.row_number().over(within) - 1)
    sums = part.groupBy(*key, *block).agg(F.sum((1 - d) * F.pow(F.lit(d), F.col("__after")) * F.col("__x")).alias("__s"), F.count("*").alias("__n"))
    later = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in block]).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("__after", F.coalesce(F.sum("__n").over(later), F.lit(0))).groupBy(*key).agg(F.coalesce(F.sum(F.pow(F.lit(d), F.col("__after")) * F.col("__s")), F.lit(0.0)).alias("state"))


def attention(query: Column, keys: Column, values: Column) -> Column:
    """Scaled dot-product attention of one query over arrays of keys and values."""
    weights = softmax(F.transform(keys, lambda k: dot(query, k) / F.sqrt(F.size(query).cast("double"))))
    parts = F.zip_with(weights, values, lambda w, v: F.transform(v, lambda x: w * dbl(x)))
    zero = F.transform(values[0], lambda _: F.lit(0.0))
    return F.aggregate(parts, zero, lambda a, p: F.zip_with(a, p, lambda x, y: x + y))


# Sequences as rows, one state for each key


GATES = {"rnn": 1, "gru": 3, "lstm": 4, "cfc": 4, "ctrnn": 1, "ctgru": 3, "ltc": 1, "stride": 1}


@dataclass
class Cell:
    """A recurrent cell with seeded weights for d inputs and h units.

    Kinds: ``rnn``, ``gru`` (gates z, r, candidate), ``lstm`` and ``cfc`` (i, f, o, c), ``ctrnn``,
    ``ctgru`` (u, r, candidate), ``ltc`` (``unfolds`` steps of the full elapsed time, by the
    ``solver`` euler, heun or rk4) and ``stride`` (the elapsed time divides).
    """

    kind: str
    d: int
    h: int
    seed: int = 0
    tau: float = 1.0
    unfolds: int = 6
    stride: float = 1.0
    clip: float | None = None
    eps: float = 1e-8
    solver: str = "euler"

    def __post_init__(self):
        rng, gates = np.random.default_rng(self.seed), GATES[self.kind]
        limit = math.sqrt(6 / (self.d + self.h))
        self.w = rng.uniform(-limit, limit, (gates, self.d, self.h))
        self.u = rng.uniform(-limit, limit, (gates, self.h, self.h))
        self.b, self.ub = np.zeros((gates, self.h)), np.zeros((gates, self.h))
        if self.kind == "ltc":
            self.leak, self.rest, self.cm = np.ones(self.h), np.zeros(self.h), np.ones(self.h)
            self.erev, self.sensory = rng.uniform(-1, 1, (self.h, self.h)), rng.uniform(-limit, limit, (self.d, self.d))
            self.sensory_erev = rng.uniform(-1, 1, (self.d, self.h))

    def step(self, state: tuple[np.ndarray, np.ndarray], x: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
        h, c = state
        s = lambda z: 1 / (1 + np.exp(-z))
        if self.kind == "ltc":
            return self._flow(h, x, dt), c
        a, r = x @ self.w + self.b, h @ self.u + self.ub
        if self.kind == "rnn":
            return np.tanh(a[0] + r[0]), c
        if self.kind == "gru":
            z, reset = s(a[0] + r[0]), s(a[1] + r[1])
            return z * h + (1 - z) * np.tanh(a[2] + reset * r[2]), c
        if self.kind in ("lstm", "cfc"):
            i, f, o = (s(a[k] + r[k]) for k in range(3))
            c = f * c + i * np.tanh(a[3] + r[3])
            if self.kind == "lstm":
                return o * np.tanh(c), c
            keep = math.exp(-dt / self.tau)
            return o * np.tanh(keep * h + (1 - keep) * c), c
        if self.kind == "stride":
            return h + (a[0] + r[0] - h) / (self.tau * dt * self.stride), c
        target = np.tanh(a[0] + r[0])
        if self.kind == "ctgru":  # the reset gate has no part in the candidate
            gate = s(a[0] + r[0])
            target = (1 - gate) * h + gate * np.tanh(a[2] + r[2])
        h = h + dt * (target - h) / (self.tau + self.eps)
        return (h if self.clip is None else np.clip(h, -self.clip, self.clip)), c

    def _flow(self, v: np.ndarray, x: np.ndarray, dt: float) -> np.ndarray:
        """Leak, synaptic and sensory currents with reversal potentials."""
        leak, cm = np.abs(self.leak) + self.eps, np.abs(self.cm) + self.eps
        felt = np.tanh(x) @ self.sensory.T

        def slope(v: np.ndarray) -> np.ndarray:
            met = np.tanh(v) @ self.u[0]
            synaptic = (met[None, :] * (self.erev - v[:, None])).sum(axis=1)
            return (leak * (self.rest - v) + synaptic + (felt[:, None] * (self.sensory_erev - v[None, :])).sum(axis=0)) / cm

        for _ in range(self.unfolds):
            k = slope(v)
            if self.solver == "heun":
                k = (k + slope(v + dt * k)) / 2
            elif self.solver == "rk4":
                mid = slope(v + dt * k / 2)
                again = slope(v + dt * mid / 2)
                k = (k + 2 * mid + 2 * again + slope(v + dt * again)) / 6
            v = v + dt * k
        return v


def run_cell(df: DataFrame, cell: Cell, key: str, order: str, xs: list[str], dt: str | None = None, backward: bool = False) -> DataFrame:
    """``key``, ``order`` and the state ``h`` after each row, from the first or (``backward``) from the last.

    Rows are sorted by Spark and streamed; a task holds one state, not a sequence.
    """
    cols = [key, order, *xs, *([dt] if dt else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if state is None or row[0] != now:
                    now, state = row[0], (np.zeros(cell.h), np.zeros(cell.h))
                x = np.nan_to_num(np.array(row[2 : 2 + len(xs)], dtype=float))
                state = cell.step(state, x, float(row[-1]) if dt else 1.0)
                out.append(state[0].tolist())
            yield pd.DataFrame({key: batch[key], order: batch[order], "h": out})

    kinds = dict(df.dtypes)
    sort = F.desc(order) if backward else F.asc(order)
    return df.select(*cols).repartition(key).sortWithinPartitions(F.asc(key), sort).mapInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, h array<double>")


def run_both_ways(df: DataFrame, ahead: Cell, back: Cell, key: str, order: str, xs: list[str], dt: str | None = None) -> DataFrame:
    """A bidirectional layer: ``h`` is the state of both cells, one run from each end."""
    one, two = run_cell(df, ahead, key, order, xs, dt), run_cell(df, back, key, order, xs, dt, True).withColumnRenamed("h", "__b")
    return one.join(two, [key, order]).select(key, order, F.concat("h", "__b").alias("h"))


# Wirings


def wiring(spark, inputs: int, inter: int, command: int, motor: int, density: float = 0.5, seed: int = 0) -> DataFrame:
    """A neural-circuit-policy wiring as edges ``src, dst, w`` with signs; layers feed forward, commands also each other."""
    rng = np.random.default_rng(seed)
    names = [("s", inputs), ("i", inter), ("c", command), ("m", motor)]
    pairs = [(0, 1), (1, 2), (2, 2), (2, 3)]
    edges = [(f"{names[a][0]}{i}", f"{names[b][0]}{j}", float(rng.choice([-1, 1]))) for a, b in pairs for i in range(names[a][1]) for j in range(names[b][1]) if rng.random() < density]
    return spark.createDataFrame(edges, "src string, dst string, w double")
