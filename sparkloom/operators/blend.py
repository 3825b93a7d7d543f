"""Components of windows and of column groups.

A window of a series is one vector: its columns at each of its steps.  The vectors of
each stride are reduced by their principal components, fitted with one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.ieee import dbl
from sparkloom.operators import features as E
from sparkloom.operators.linalg import PCA, fit_pca

#: No more components than this, unless asked for.
MOST = 32


def flat_windows(df: DataFrame, key: list[str], order: list[str], columns: list[str], width: int, stride: int) -> DataFrame:
    """``key``, ``start`` and a column ``t{step}_{column}`` for each value of the whole windows that start at multiples of ``stride``."""
    w = Window.partitionBy(*key).orderBy(*order)
    ahead = [F.lead(dbl(F.col(c)), t).over(w).alias(f"t{t}_{c}") for t in range(width) for c in columns]
    rows = df.select(*key, (F.row_number().over(w) - 1).alias("start"), F.lead(F.lit(1), width - 1).over(w).alias("__whole"), *ahead)
    return rows.where((F.col("start") % stride == 0) & F.col("__whole").isNotNull()).drop("__whole")


@dataclass
class Blend:
    """Fitted components of the windows of each stride."""

    key: list[str]
    order: list[str]
    columns: list[str]
    width: int
    models: dict[int, PCA]

    def transform(self, df: DataFrame, stride: int) -> DataFrame:
        """``key``, ``start`` and ``pca_0``, ``pca_1``, ... of each window."""
        m = self.models[stride]
        rows = flat_windows(df, self.key, self.order, self.columns, self.width, stride)
        return rows.select(*self.key, "start", *[e.alias(n) for n, e in m.exprs().items()])

    def explained(self, stride: int) -> float:
        """The share of the variance that the components hold."""
        return float(self.models[stride].ratio.sum())

    def importance(self, stride: int) -> dict[str, float]:
        """For each step and column, the sum of the components' absolute entries."""
        return self.models[stride].importance()


def fit_blend(df: DataFrame, key: list[str], order: list[str], columns: list[str], width: int, strides: list[int], components: int | None = None) -> Blend:
    """Components for each stride: ``components``, or half the values of a window and ``MOST`` at most; fewer than windows."""
    models = {}
    for stride in strides:
        rows = flat_windows(df, key, order, columns, width, stride)
        names = [f"t{t}_{c}" for t in range(width) for c in columns]
        m = fit_pca(rows, names)
        k = max(0, min(components or min(len(names) // 2, MOST), len(names), m.n - 1))
        models[stride] = PCA(names, m.mean, m.components[:k], m.variance[:k], m.ratio[:k], m.n)
    return Blend(key, order, columns, width, models)


def engineered_by_kind(df: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """The engineered columns (the table's others stay) and their names by the kind of column they come from."""
    out = E.engineer(df, kinds)
    made = [c for c in out.columns if c not in df.columns]
    groups: dict[str, list[str]] = {}
    for name in made:
        source = max((c for c in kinds if name.startswith(f"{c}_")), key=len)
        groups.setdefault(kinds[source], []).append(name)
    return out, groups


def pca_by_group(df: DataFrame, groups: dict[str, list[str]], components: int | float | None = None, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, PCA]]:
    """``keep`` and the scores ``{group}_pca_{i}`` of each group of two columns or more, and the fitted models."""
    models = {g: fit_pca(df, names, components) for g, names in groups.items() if len(names) > 1}
    scores = [e.alias(f"{g}_{n}") for g, m in models.items() for n, e in m.exprs().items()]
    return df.select(*(keep or []), *scores), models
