"""Linear algebra of tables: one distributed aggregate and a small dense step.

For a table of n rows and d columns only d x d sums ever leave the executors, whatever
n is; d is the number of columns named.  Many small matrices, one for each key, are
solved where Spark has put them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.ieee import dbl
from sparkloom.operators.dense import as_rows, moments, triangle

#: More columns than this give their products in blocks.
WIDE = 32


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, column sums and the matrix of sums of products, in one pass."""
    d = len(columns)
    if d > WIDE:  # an aggregate for each pair would take longer to compile than to run
        m = np.zeros((d + 1, d + 1))
        for r in moments(as_rows(df, columns), d).collect():  # d + 1 rows
            m[r["i"]] = r["x"]
        return int(m[0, 0]), m[0, 1:], m[1:, 1:]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = df.agg(F.count("*"), *[F.sum(dbl(F.col(c))) for c in columns], *[F.sum(dbl(F.col(columns[i])) * dbl(F.col(columns[j]))) for i, j in pairs]).first()
    g = np.zeros((d, d))
    for (i, j), v in zip(pairs, row[1 + d :]):
        g[i, j] = g[j, i] = v or 0.0
    return row[0], np.array([x or 0.0 for x in row[1 : 1 + d]]), g


def gram_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """The sums of products as rows ``a, b, v``."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.sum(dbl(F.col(a)) * dbl(F.col(b))).alias("v")) for a in columns for b in columns]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def covariance_table(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(dbl(F.col(a)), dbl(F.col(b))).alias("v")) for a in columns for b in columns]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def linear(columns: list[str], weights, bias: float = 0.0) -> Column:
    out = F.lit(float(bias))
    for c, w in zip(columns, weights):
        out = out + dbl(F.col(c)) * float(w)
    return out


def least_squares(df: DataFrame, xs: list[str], y: str, ridge: float = 0.0) -> np.ndarray:
    """Intercept and slopes by the normal equations; the least-norm answer if they are singular."""
    n, s, g = gram(df, [*xs, y])
    d = len(xs)
    a = np.zeros((d + 1, d + 1))
    a[0, 0], a[0, 1:], a[1:, 0], a[1:, 1:] = n, s[:d], s[:d], g[:d, :d] + ridge * np.eye(d)
    return np.linalg.pinv(a) @ np.concatenate([[s[d]], g[:d, d]])


@dataclass
class PCA:
    """Principal components of named columns; the largest entry of each is positive."""

    columns: list[str]
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray
    n: int = 0

    def exprs(self, prefix: str = "pca", whiten: bool = False) -> dict[str, Column]:
        scale = np.sqrt(np.maximum(self.variance, 1e-12)) if whiten else np.ones(len(self.variance))
        return {f"{prefix}_{i}": linear(self.columns, c / s, -float(c @ self.mean) / s) for i, (c, s) in enumerate(zip(self.components, scale))}

    def transform(self, df: DataFrame, prefix: str = "pca", whiten: bool = False) -> DataFrame:
        return df.withColumns(self.exprs(prefix, whiten))

    def inverse_exprs(self, prefix: str = "pca") -> dict[str, Column]:
        scores = [f"{prefix}_{i}" for i in range(len(self.components))]
        return {c: linear(scores, self.components[:, j], self.mean[j]) for j, c in enumerate(self.columns)}

    def importance(self) -> dict[str, float]:
        return dict(zip(self.columns, np.abs(self.components).sum(axis=0).tolist()))


def likely_components(variance: np.ndarray, n: int) -> int:
    """How many components make ``n`` rows with these variances likeliest, by the log-likelihood of the rest as noise."""
    m, best = len(variance), []
    for kept in range(1, m + 1):
        head, rest = variance[:kept], m - kept
        noise = variance[kept:].mean() if rest else 0.0
        fit = np.log(np.maximum(head, 1e-300)).sum()
        if rest and noise > 0:
            fit += rest * np.log(noise) + rest / (rest + 1) + head.sum() / noise + rest
        best.append(0.0 if rest and noise <= 0 else -0.5 * n * fit)
    return int(np.argmax(best)) + 1 if m else 0


def fit_pca(df: DataFrame, columns: list[str], k: int | float | str | None = None) -> PCA:
    """``k`` components, as many as explain the share ``k``, the likeliest number (``"mle"``), or all of them."""
    return pca_of(columns, *gram(df, columns), k)


def pca_of(columns: list[str], n: int, s: np.ndarray, g: np.ndarray, k: int | float | str | None = None) -> PCA:
    """The components that count, sums and sums of products give: those of one pass, or merged ones of many batches."""
    mean = s / max(n, 1)
    values, vectors = np.linalg.eigh((g - n * np.outer(mean, mean)) / max(n - 1, 1))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    ratio = values / (values.sum() or 1.0)
    if isinstance(k, float):
        k = int(np.searchsorted(np.cumsum(ratio), k) + 1)
    elif k == "mle":
        k = likely_components(values, n)
    k = min(len(columns), k or len(columns))
    flip = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return PCA(columns, mean, (vectors * np.where(flip == 0, 1, flip)[:, None])[:k], values[:k], ratio[:k], n)


def svd(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a tall table; left ones are a linear expression of them."""
    values, vectors = np.linalg.eigh(gram(df, columns)[2])
    return np.sqrt(np.maximum(values[::-1], 0)), vectors[:, ::-1].T


def qr(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R of the reduced QR by a tree of small ones: a factor of d rows from each partition.

    Factors are combined on the executors level by level, each behind an exchange of d rows a
    partition, so that every partition is read by its own task and the driver gets one factor.
    """
    return triangle(as_rows(df, columns), len(columns))


def _of_each(a: DataFrame, key: list[str], n: int, fn, kind: str, most: int = 512) -> DataFrame:
    """``key`` and ``out``, ``fn`` of the ``n`` x ``n`` matrix of each key; absent cells are 0.

    ``a`` holds many small matrices as rows ``key, i, j, v``.  Spark brings the cells of a
    key together (at most ``most`` squared) and deals the matrices out.
    """
    if n > most:
        raise ValueError(f"{n} rows are more than {most}: use solve_large, inverse_large or log_det_large of the module dense")

    @F.pandas_udf(kind)
    def run(cells: pd.Series) -> pd.Series:
        out = []
        for some in cells:
            m = np.zeros((n, n))
            for c in some:
                m[c["i"], c["j"]] = c["v"]
            out.append(fn(m))
        return pd.Series(out)

    inside = F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1)
    summed = a.where(inside).groupBy(*key, "i", "j").agg(F.sum(dbl(F.col("v"))).alias("v"))
    return summed.groupBy(*key).agg(F.collect_list(F.struct("i", "j", "v")).alias("cells")).where(F.size("cells") > 0).select(*key, run("cells").alias("out"))


def det(a: DataFrame, n: int, key: list[str] | None = None) -> DataFrame:
    """``key`` and ``det`` of each matrix."""
    return _of_each(a, key or [], n, lambda m: float(np.linalg.det(m)), "double").withColumnRenamed("out", "det")


def inverse(a: DataFrame, n: int, key: list[str] | None = None) -> DataFrame:
    """``key, i, j, v`` of the inverse of each matrix; the task fails on a singular one."""
    out = _of_each(a, key or [], n, lambda m: np.linalg.inv(m).ravel().tolist(), "array<double>")
    return out.select(*(key or []), F.posexplode("out").alias("at", "v")).select(*(key or []), F.floor(F.col("at") / n).alias("i"), (F.col("at") % n).cast("long").alias("j"), "v")


def solve(a: DataFrame, n: int, b: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``key, i, v``: the solution of each system; ``b`` has rows ``key, i, v``, absent ones 0."""
    key = key or []
    inv = inverse(a, n, key).withColumnRenamed("v", "__w")
    right = b.select(*key, F.col("i").alias("j"), dbl(F.col("v")).alias("__b"))
    return inv.join(right, [*key, "j"], "left").groupBy(*key, "i").agg(F.sum(F.col("__w") * F.coalesce("__b", F.lit(0.0))).alias("v"))


def eigenvalues(a: DataFrame, n: int, key: list[str] | None = None) -> DataFrame:
    """``key, i, re, im``: the eigenvalues of each matrix, sorted by real and then imaginary part."""

    def values(m: np.ndarray) -> list[dict]:
        return [{"re": float(z.real), "im": float(z.imag)} for z in np.sort_complex(np.linalg.eigvals(m))]

    out = _of_each(a, key or [], n, values, "array<struct<re:double,im:double>>")
    return out.select(*(key or []), F.posexplode("out").alias("i", "z")).select(*(key or []), "i", "z.re", "z.im")


def cholesky(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The lower factor of the matrix of sums of products."""
    return np.linalg.cholesky(gram(df, columns)[2])


def orthogonal(n: int, m: int, gain: float = 1.0, seed: int = 0) -> np.ndarray:
    """A (semi-)orthogonal start matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(max(n, m), min(n, m))))
    q = q * np.sign(np.diag(r))
    return gain * (q if n >= m else q.T)
