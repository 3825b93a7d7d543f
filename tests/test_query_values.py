"""Rows of queries that have no SQL, against plain NumPy over the same tables."""

import numpy as np
import pandas as pd
import pytest

from sparkloom.operators import models as N
from sparkloom.plans import registry
from tests.conftest import SF

QUERIES = registry.queries()


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def test_pca_scores(spark):
    names = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    li = pd.read_parquet(f"{SF}/lineitem.parquet")
    x = li[names].astype(float).to_numpy()
    x = x - x.mean(axis=0)
    variance, axes = np.linalg.eigh(x.T @ x)
    top = axes[:, np.argsort(-variance)[:2]]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), [0, 1]])
    want = np.column_stack([li["l_orderkey"], x @ top])
    got = QUERIES["pca_scores"](spark, SF).toPandas()[["l_orderkey", "pca_0", "pca_1"]].to_numpy(dtype=float)
    assert len(got) == len(want)
    order = lambda a: a[np.lexsort((a[:, 1].round(3), a[:, 0]))]
    assert order(got) == pytest.approx(order(want), rel=1e-6, abs=1e-6)


def test_recurrent_cells(spark):
    cell = N.Cell("gru", 1, 3)
    ev = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "event_id"])
    want, now, h = {}, None, np.zeros(3)
    for user, event, value in zip(ev["user_id"], ev["event_id"], ev["value"]):
        if user != now:
            now, h = user, np.zeros(3)
        x = 0.0 if pd.isna(value) else value / 100
        z, r = (sigmoid(x * cell.w[k, 0] + h @ cell.u[k]) for k in (0, 1))
        h = z * h + (1 - z) * np.tanh(x * cell.w[2, 0] + r * (h @ cell.u[2]))
        want[user, event] = h
    got = {(r["user_id"], r["event_id"]): r["h"] for r in QUERIES["recurrent_cells"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(want) == len(ev)
    assert np.array([got[k] for k in want]) == pytest.approx(np.array(list(want.values())))


def test_rbm_trained(spark):
    li = pd.read_parquet(f"{SF}/lineitem.parquet")
    v = np.column_stack([li["l_quantity"].astype(float) / 50, li["l_discount"].astype(float) * 10, li["l_tax"].astype(float) * 12])
    w, a, b = np.random.default_rng(0).normal(scale=0.1, size=(3, 2)), np.zeros(3), np.zeros(2)
    for _ in range(3):
        h = sigmoid(v @ w + b)
        r = sigmoid(h @ w.T + a)
        g = sigmoid(r @ w + b)
        w, a, b = w + 0.1 * (v.T @ h - r.T @ g) / len(v), a + 0.1 * (v - r).mean(axis=0), b + 0.1 * (h - g).mean(axis=0)
    error = ((v - sigmoid(sigmoid(v @ w + b) @ w.T + a)) ** 2).sum(axis=1)
    got = QUERIES["rbm_trained"](spark, SF).toPandas()
    rows, plain = (np.array(sorted(zip(k, e))) for k, e in ((got["l_orderkey"], got["error"]), (li["l_orderkey"], error)))
    assert rows == pytest.approx(plain, abs=1e-9)
    bound = np.quantile(error, 0.95)
    clear = (got["error"] - bound).abs() > 1e-3
    assert (got["anomaly"] == (got["error"] > bound))[clear].all() and got["anomaly"].mean() == pytest.approx(0.05, abs=0.01)
