"""Quantiles by refinement, pair sums in one scan, lasso paths and boosted trees."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import boosting, gram, quantiles, selection
from barloom.operators.quantiles import exact_quantiles, values_at_ranks
from barloom.session import settle

SPREADS = {
    "even": lambda r: r.random(), "tied": lambda r: float(r.choice([1, 1, 1, 2, 5])), "wide": lambda r: r.choice([1e-300, 1e300, -1e308, 1e308, r.random()]),
    "near": lambda r: 1.0 + r.random() * 1e-12, "odd": lambda r: r.choice([math.inf, -math.inf, math.nan, 0.0, -0.0, r.gauss(0, 1)]),
    "one": lambda r: 3.0, "heavy": lambda r: math.exp(60 * r.random())}


@pytest.mark.parametrize("refined", [0, 1_000_000])
def test_ranks_of_any_spread(spark, monkeypatch, refined):
    monkeypatch.setattr(quantiles, "REFINED", refined)
    r = random.Random(1)
    rows = [(k, make(r) if r.random() > 0.1 else None) for k, make in SPREADS.items() for _ in range(700)] + [("none", None), ("single", 4.0)]
    df = settle(spark.createDataFrame(rows, "k string, v double"), "spreads")
    wanted = {"lo": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "hi": lambda n: n - 1}
    for size in (2_000_000, 40):
        got = {r.k: (r.lo, r.mid, r.hi, r._size) for r in values_at_ranks(df, ["k"], "v", wanted, size).collect()}
        assert set(got) == {*SPREADS, "single"}
        for k in got:
            values = sorted((v for key, v in rows if key == k and v is not None), key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0))
            want = (values[0], values[len(values) // 2], values[-1])
            assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(got[k][:3], want, strict=True)), k
            assert got[k][3] == len(values)
    whole = exact_quantiles(df.where("k = 'even'"), [], "v", (0.1, 0.5)).first()
    assert np.allclose(list(whole), np.quantile([v for k, v in rows if k == "even" and v is not None], [0.1, 0.5]), rtol=1e-14)


def test_ranks_shuffle_no_rows(spark):
    """Rows are not shuffled: the table of values that is written holds a small part of the distinct ones."""
    df = settle(spark.range(200_000).select((F.col("id") % 3).alias("k"), F.rand(3).alias("v")), "many")
    picked = values_at_ranks(df, ["k"], "v", {"mid": lambda n: F.floor(n / 2)})
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert "many-" not in plan  # only what was counted and selected is read
    assert picked.count() == 3


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 7))
    x[:, 4] = x[:, 0] * 2 + rng.normal(size=900) * 0.1
    x[:, 6] = 5.0
    x[rng.random((900, 7)) < 0.05] = np.nan
    y = 3 * np.nan_to_num(x[:, 1]) - np.nan_to_num(x[:, 2]) + rng.normal(size=900)
    rows = [(int(i), ["a", "b", None][i % 3], *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i]) if i % 50 else None) for i in range(900)]
    names = ", ".join(f"c{j} double" for j in range(7))
    return settle(spark.createDataFrame(rows, f"id long, k string, {names}, y double").repartition(5), "table")


COLUMNS = [f"c{j}" for j in range(7)]


def test_pair_sums(table):
    whole = table.toPandas()
    for keys, tile in ((), 256), (("k",), 256), (("k",), 3):
        got = {(*[r[k] for k in keys], r.f1, r.f2): r["corr"] for r in gram.correlation(gram.pair_sums(table, COLUMNS, keys, tile=tile), COLUMNS, keys).collect()}
        parts = {(): whole} if not keys else {(k,): whole[whole.k == k] if k else whole[whole.k.isna()] for k in ("a", "b", None)}
        assert len(got) == 21 * len(parts)
        for key, part in parts.items():
            want = part[COLUMNS].corr()
            for i, a in enumerate(COLUMNS):
                for b in COLUMNS[i + 1:]:
                    c, w = got[(*key, a, b)], want.loc[a, b]
                    assert c is None and np.isnan(w) or abs(c - w) < 1e-9


def test_pairs_of_many_columns_take_one_scan(spark):
    names = [f"x{i}" for i in range(600)]
    df = settle(spark.range(300).select(*[F.rand(i).alias(c) for i, c in enumerate(names)]), "wide")
    made = selection.correlations(df, names)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert made.count() == 600 * 599 // 2
    got = {(r.f1, r.f2): r["corr"] for r in made.where("f1 in ('x3', 'x598')").collect()}
    want = df.select("x3", "x598", "x599").toPandas().corr()
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-9 for a, b in (("x3", "x598"), ("x3", "x599"), ("x598", "x599")))


def test_lasso_path(table):
    """The solution's sub-gradient at the chosen penalty, and the choice, against paths solved on the rows."""
    features = COLUMNS
    for keys in ((), ("k",)):
        got = gram.lasso(table, features, "y", order="id", keys=keys).toPandas()
        whole = table.where("y is not null").toPandas().sort_values("id")
        low, high = whole.id.min(), whole.id.max()
        whole["fold"] = (whole.id - low) * 5 // (high - low + 1)
        for key, part in [(None, whole)] if not keys else [(k, whole[whole.k.isna()] if k is None else whole[whole.k == k]) for k in ("a", "b", None)]:
            mine = got if not keys else got[got.k.isna()] if key is None else got[got.k == key]
            x = part[features].fillna(0).to_numpy()
            scale = np.where(x.std(0) > 0, x.std(0), 1)
            z, y = (x - x.mean(0)) / scale, part.y.to_numpy()
            w, penalty = mine.set_index("feature").coefficient[features].to_numpy(), mine.penalty.iloc[0]
            slope = z.T @ (y - y.mean() - z @ w) / len(y)
            assert np.all(np.abs(slope[w != 0] - penalty * np.sign(w[w != 0])) < 1e-8) and np.all(np.abs(slope[w == 0]) <= penalty + 1e-8)
            grid = np.abs(z.T @ (y - y.mean()) / len(y)).max() * 1e-3 ** (np.arange(100) / 99)
            errors = []
            for a in grid:
                e = []
                for f in range(5):
                    t = (part.fold != f).to_numpy()
                    zt, yt = z[t] - z[t].mean(0), y[t] - y[t].mean()
                    v = gram.descend(zt.T @ zt / t.sum(), zt.T @ yt / t.sum(), a, np.zeros(7))
                    e.append((((y[~t] - y[t].mean()) - (z[~t] - z[t].mean(0)) @ v) ** 2).mean())
                errors.append(np.mean(e))
            assert abs(grid[int(np.argmin(errors))] - penalty) < 1e-9 and abs(min(errors) - mine.error.iloc[0]) < 1e-8


def test_boosted_trees_learn(table):
    made = boosting.boosted(table.withColumns({"t1": F.col("y"), "t2": -2 * F.col("y")}), COLUMNS, {1: "t1", 2: "t2"}, ["k"], ["id"], trees=6, depth=3, rate=0.3)
    errors = made.errors().collect()
    assert len(errors) == 4 and all(r.error < 0.75 * r.base_error for r in errors)
    shares = made.importance.toPandas()
    assert np.allclose(shares.groupby(["k", "horizon"]).importance.sum(), 100)
    assert (shares.sort_values("importance").groupby(["k", "horizon"]).feature.last() == "c1").all()
    assert made.rows.count() == 2 * table.where("y is not null and k is not null").count()
