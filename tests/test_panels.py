import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import classification, labels, returns, risk, simulate, splits, trades, vector, weights
from tidemark.operators import cross_section as xs

START = datetime.date(2026, 1, 1)
DAY = lambda i: START + datetime.timedelta(i)


def series(spark, values, name="ret", symbol="A"):
    return spark.createDataFrame([(symbol, DAY(i), None if v is None else float(v)) for i, v in enumerate(values)], f"symbol string, ts date, {name} double")


def test_ranks(spark):
    df = spark.createDataFrame([(DAY(0), "A", 1.0), (DAY(0), "B", 3.0), (DAY(0), "C", 2.0), (DAY(1), "A", 4.0), (DAY(1), "B", 4.0), (DAY(1), "C", None)], "ts date, symbol string, x double")
    got = lambda d, c: {(r.ts, r.symbol): r[c] for r in d.collect()}
    avg = got(xs.rank(df, "x"), "rank")
    assert [avg[DAY(0), s] for s in "ABC"] == [1, 3, 2] and [avg[DAY(1), s] for s in "ABC"] == [1.5, 1.5, None]
    assert got(xs.rank(df, "x", method="first"), "rank")[DAY(1), "B"] == 2
    assert got(xs.rank(df, "x", na_option="top"), "rank")[DAY(1), "C"] == 1 and got(xs.rank(df, "x", na_option="bottom"), "rank")[DAY(1), "C"] == 3
    pct = got(xs.percentile_rank(df, "x"), "pct_rank")
    assert [pct[DAY(0), s] for s in "ABC"] == pytest.approx([1 / 3, 1, 2 / 3])
    z = got(xs.zscore(df, "x"), "zscore")
    assert sum(z[DAY(0), s] for s in "ABC") == pytest.approx(0) and z[DAY(1), "A"] is None


def test_group_returns_lag_weights(spark):
    rows = [(DAY(0), "A", "TECH", 0.01, 100.0), (DAY(0), "B", "TECH", 0.0, 300.0), (DAY(1), "A", "TECH", 0.1, 900.0), (DAY(1), "B", "TECH", 0.0, 1.0), (DAY(1), "C", None, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "ts date, symbol string, sectorid string, ret double, market_cap double")
    equal = {(r.ts, r.sectorid): r for r in xs.group_weighted_return(df, field="ret", field_type="simple_return").collect()}
    assert equal[DAY(0), "TECH"].weighted_return == pytest.approx(0.005) and equal[DAY(1), "UnknownSector"].weighted_return == 0.5
    cap = {(r.ts, r.sectorid): r for r in xs.group_weighted_return(df, field="ret", field_type="simple_return", weighting="market_cap").collect()}
    assert cap[DAY(0), "TECH"].weighted_return is None and cap[DAY(1), "TECH"].weighted_return == pytest.approx(0.025) and cap[DAY(1), "TECH"].weight_sum == 400


def test_elo(spark):
    rows = [(DAY(i), s, c, sec) for i in range(5) for s, c, sec in (("A", 10.0 + i + (i % 2) * 0.3, "TECH"), ("B", 20.0 - i - (i % 2) * 0.3, "TECH"), ("C", 5.0, "HEALTH"))]
    got = {(r.ts, r.symbol): r for r in xs.elo(spark.createDataFrame(rows, "ts date, symbol string, close double, sectorid string"), 2).collect()}
    last = {s: got[DAY(4), s] for s in "ABC"}
    assert last["A"].elo > 1500 > last["B"].elo and last["C"].elo == 1500
    assert [last[s].matches_played for s in "ABC"] == [3, 3, 0]


def test_neutralize(spark):
    rng = np.random.default_rng(0)
    rows = [(DAY(0), f"s{i}", float(rng.normal()), float(rng.normal()), "ab"[i % 2], float(rng.random() + 0.1)) for i in range(20)]
    df = spark.createDataFrame(rows, "ts date, symbol string, x double, beta double, sector string, w double")
    got = xs.neutralize(df, "x", ["beta", "sector"], weights="w").toPandas()
    a = np.column_stack((np.ones(20), got.beta, got.sector == "b")).astype(float)
    assert np.allclose((a * got.w.to_numpy()[:, None]).T @ got.residual.to_numpy(float), 0)
    one = xs.demean(df, "x", "sector", weights="w").toPandas()
    two = xs.neutralize(df, "x", ["sector"], weights="w").toPandas()
    assert np.allclose(one.sort_values("symbol").residual, two.sort_values("symbol").residual.astype(float))


@pytest.mark.parametrize("weights, intercept", [(None, True), ("w", True), ("w", False)])
@pytest.mark.parametrize("exposures", [["a"], ["a", "b", "twice", "flat"], ["sector"], ["a", "sector", "b"]])
def test_neutralize_equals_least_squares(spark, exposures, weights, intercept):
    """Nulls, exposures that others explain, a constant one, and a date with too few rows."""
    rng = np.random.default_rng(5)
    rows = []
    for d, n in enumerate((30, 12, 2)):
        for i in range(n):
            a, b = (None if rng.random() < 0.1 else float(v) for v in rng.normal(3, 1, 2))
            rows.append((DAY(d), f"s{i}", float(rng.normal()), a, b, None if a is None else 2 * a, 7.0, [None, "x", "y", "z"][rng.integers(0 if n == 12 else 1, 4)], float(rng.random() + 0.1)))
    df = spark.createDataFrame(rows, "ts date, symbol string, x double, a double, b double, twice double, flat double, sector string, w double")
    got = xs.neutralize(df, "x", exposures, weights=weights, add_intercept=intercept).toPandas().sort_values(["ts", "symbol"])
    want = []
    for _, day in df.toPandas().sort_values(["ts", "symbol"]).groupby("ts"):
        ok = day[exposures].notna().all(axis=1).to_numpy()
        m = pd.get_dummies(day[exposures], drop_first=intercept, dtype=float).to_numpy(float)[ok]
        m = np.column_stack((np.ones(len(m)), m)) if intercept else m
        y, left = day.x.to_numpy()[ok], np.full(len(day), np.nan)
        if len(y) > m.shape[1]:
            s = np.sqrt(day.w.to_numpy()[ok]) if weights else np.ones(len(y))
            left[ok] = y - m @ np.linalg.lstsq(m * s[:, None], y * s, rcond=None)[0]
        want += left.tolist()
    assert got.columns.tolist() == [*df.columns, "residual"]
    assert np.allclose(got.residual.astype(float), want, equal_nan=True)


def test_open_days_equal_brute_force(spark):
    """Spans that touch, nest, repeat and go over several days of entries; a trade that never closed adds nothing."""
    rng = np.random.default_rng(6)
    at = lambda h: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=int(h))
    spans = [(g, int(a), int(a + rng.integers(0, 60) ** 2 // 60)) for g in "ab" for a in rng.integers(0, 900, 60)]
    spans += [("c", 5, 5), ("c", 30, 100), ("c", 40, 50), ("c", 30, 100), ("c", 100, 101), ("c", 400, 401)]
    rows = [(g, at(a), at(b)) for g, a, b in spans] + [("c", at(200), None)]
    got = {r["group"]: r["__open"] for r in trades._open_days(spark.createDataFrame(rows, "group string, entry_time timestamp, exit_time timestamp"), ["group"]).collect()}
    for g in "abc":
        hours = {h for k, a, b in spans if k == g for h in range(a, b)}
        assert got[g] == pytest.approx(len(hours) / 24)


PRICES = [100, 103, 104, 100, 97, 96, 100, 101, 101]


def test_barriers(spark):
    df = series(spark, PRICES, "close").withColumn("e", F.datediff("ts", F.lit(START)))
    at = {0: 0, 3: 1, 6: 2}
    got = {r.e: r for r in labels.triple_barrier(df, target=0.02, horizon=2, event="e in (0, 3, 6)").collect()}
    assert [got[k].barrier for k in at] == ["upper", "lower", "vertical"] and [got[k].label for k in at] == [1, -1, 1]
    assert [got[k].ret for k in at] == pytest.approx([0.03, -0.03, 0.01])
    fixed = {r.e: r.label for r in labels.fixed_horizon(df, horizon=2, threshold=0.015, drop_censored=False, event="e in (0, 3, 6, 7)").collect()}
    assert fixed == {0: 1, 3: -1, 6: 0, 7: None}
    cens = {r.e: r.barrier for r in labels.triple_barrier(df, target=0.5, horizon=2, drop_censored=False, event="e > 5").collect()}
    assert cens == {6: "vertical", 7: "censored", 8: "censored"}
    assert {r.e: r.vertical_barrier for r in labels.vertical_barriers(df, "3 days").collect()}[5] == DAY(8)


def test_cusum(spark):
    got = labels.cusum_filter(series(spark, [100, 101, 102, 100, 98, 99], "close"), threshold=0.015).orderBy("ts").collect()
    assert [i for i, r in enumerate(got) if r.cusum_event] == [2, 3, 4]


def test_trends(spark):
    p = [math.exp(x) for x in (0, 0.01, 0.02, 0.03, 0.03, 0.02, 0.01, 0, 0, 0, 0, 0)]
    df = series(spark, p, "close").withColumn("e", F.datediff("ts", F.lit(START)))
    got = {r.e: r for r in labels.trend_scanning(df, horizons=(2, 3), event="e in (0, 4, 8)").collect()}
    assert [got[k].label for k in (0, 4, 8)] == [1, -1, 0] and {r.horizon for r in got.values()} == {2}
    assert got[0].t_value == float("inf")


def test_prune(spark):
    df = spark.createDataFrame([(i, 0) for i in range(8)] + [(8, 1), (9, 1), (10, -1)], "ts int, label int")
    kept, report = labels.prune_labels(df, min_fraction=0.15)
    assert kept.count() == 10 and {r.label: r.drop_step for r in report.collect()} == {0: None, 1: None, -1: 1}


def test_intervals(spark):
    obs = series(spark, [100, 101, 103, 102, 104], "close")
    events = spark.createDataFrame([("A", DAY(0), DAY(2)), ("A", DAY(1), DAY(3))], "symbol string, start_ts date, end_ts date")
    assert [r.concurrency for r in weights.concurrency(obs, events).orderBy("ts").collect()] == [1, 2, 2, 1, 0]
    assert weights.indicator_matrix(obs, events).count() == 6
    assert [r.uniqueness for r in weights.average_uniqueness(obs, events).orderBy("start_ts").collect()] == pytest.approx([2 / 3, 2 / 3])
    purged = weights.purging_metadata(obs, events, embargo=1).orderBy("start_ts").collect()
    assert [r.overlaps_previous for r in purged] == [False, True] and [r.next_safe_position for r in purged] == [4, None]
    r = np.diff(np.log([100, 101, 103, 102]))
    raw = [abs(r[0] / 2 + r[1] / 2), abs(r[0] / 2 + r[1] / 2 + r[2])]
    assert [x.weight for x in weights.sample_weights(obs, events).orderBy("start_ts").collect()] == pytest.approx(list(np.array(raw) / np.mean(raw)))
    assert weights.sequential_bootstrap(obs, events, 7).count() == 7
    assert [x.decay for x in weights.time_decay(events.withColumn("weight", F.lit(1.0)), minimum_weight=0.5).orderBy("start_ts").collect()] == [0.75, 1.0]


def test_risk(spark):
    df = series(spark, [-0.10, -0.05, 0, 0.02, 0.03])
    one = lambda d: d.first()[1]
    assert one(risk.historical_value_at_risk(df, confidence=0.8)) == pytest.approx(0.06)
    assert one(risk.expected_shortfall(df, confidence=0.8)) == pytest.approx(0.10)
    assert one(risk.tail_conditional_expectation(df, confidence=0.8)) == pytest.approx(0.10)
    assert one(risk.expected_shortfall(df, confidence=0.7)) == pytest.approx((0.10 + 0.5 * 0.05) / 1.5)
    assert one(risk.lower_partial_moment(df, order=0)) == pytest.approx(0.4) and one(risk.maximum_observed_dollar_loss(df, 1000)) == pytest.approx(100)
    es, ev = one(risk.expected_shortfall(df)), one(risk.entropic_value_at_risk(df))
    assert es - 1e-9 <= ev <= 0.10 + 1e-3


def test_return_statistics(spark):
    rng = np.random.default_rng(2)
    r = pd.Series(rng.normal(0.001, 0.01, 300))
    df = series(spark, r)
    got = returns.statistics(df, list(returns.STATISTICS)).first().asDict()
    eq = (1 + r).cumprod()
    dd = eq / np.maximum(eq.cummax(), 1) - 1
    rho = abs(np.corrcoef(r[:-1], r[1:])[0, 1])
    want = {
        "total_return": eq.iloc[-1] - 1, "cagr": eq.iloc[-1] ** (252 / 300) - 1, "volatility": r.std() * 252**0.5, "sharpe": r.mean() / r.std() * 252**0.5, "sortino": r.mean() / np.sqrt((np.minimum(r, 0) ** 2).mean()) * 252**0.5,
        "max_drawdown": dd.min(), "skew": r.skew(), "kurtosis": r.kurt(), "ulcer_index": np.sqrt((dd**2).mean()), "profit_factor": r[r > 0].sum() / -r[r < 0].sum(), "win_rate": (r > 0).mean(), "geometric_mean": eq.iloc[-1] ** (1 / 300) - 1,
        "autocorr_penalty": math.sqrt(1 + 2 * sum((300 - k) / 300 * rho**k for k in range(1, 300))), "tail_ratio": abs(r.quantile(0.95) / r.quantile(0.05)), "payoff_ratio": r[r > 0].mean() / -r[r < 0].mean(), "profit_ratio": (r > 0).sum() / (r < 0).sum(),
    }
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-9), k
    runs = [(k, len(list(g))) for k, g in __import__("itertools").groupby(np.sign(r))]
    assert got["consecutive_wins"] == max(n for k, n in runs if k > 0) and got["consecutive_losses"] == max(n for k, n in runs if k < 0)


def test_drawdown_episodes(spark):
    got = returns.drawdown_details(series(spark, [-0.1, 0.2, -0.05, -0.05, 0.2, 0.0, -0.01])).orderBy("start").collect()
    assert [(r.start, r.valley, r.end, r.days) for r in got] == [(DAY(0), DAY(0), DAY(0), 0), (DAY(1), DAY(3), DAY(3), 2), (DAY(5), DAY(6), DAY(6), 1)]
    assert got[0].max_drawdown == pytest.approx(-0.1)


def test_empty_periods_return_nothing(spark):
    df = spark.createDataFrame([("A", datetime.date(2026, 1, 5), 0.1), ("A", datetime.date(2026, 3, 2), 0.2)], "symbol string, ts date, ret double")
    got = {r.ts: r.ret for r in returns.aggregate_returns(df, "M").collect()}
    assert got == {datetime.date(2026, 1, 31): pytest.approx(0.1), datetime.date(2026, 2, 28): 0.0, datetime.date(2026, 3, 31): pytest.approx(0.2)}
    weeks = sorted(r.ts for r in returns.aggregate_returns(df, "W").collect())
    assert weeks[0] == datetime.date(2026, 1, 5) and weeks[-1] == datetime.date(2026, 3, 2) and len(weeks) == 9


def test_factor_betas(spark):
    rng = np.random.default_rng(0)
    f = rng.normal(0, 0.01, (400, 2))
    y = 0.0002 + f @ [1.2, -0.3] + rng.normal(0, 0.001, 400)
    df = spark.createDataFrame([("A", DAY(i), float(y[i]), float(f[i, 0]), float(f[i, 1])) for i in range(400)], "symbol string, ts date, ret double, mkt double, smb double")
    for covariance in ("nonrobust", "HC3"):
        got = {r.term: r for r in returns.factor_regression(df, ["mkt", "smb"], covariance=covariance).collect()}
        assert abs(got["mkt"].coef - 1.2) < 0.1 and abs(got["smb"].coef + 0.3) < 0.1 and got["mkt"].r_squared > 0.9 and got["mkt"].lower < 1.2 < got["mkt"].upper
        x = np.column_stack((np.ones(400), f))
        inverse = np.linalg.inv(x.T @ x)
        left = y - x @ inverse @ x.T @ y
        meat = (x.T * (left / (1 - np.einsum("ij,jk,ik->i", x, inverse, x))) ** 2) @ x
        errors = np.sqrt(np.diag(inverse @ meat @ inverse if covariance == "HC3" else inverse * (left @ left) / 397))
        assert np.allclose([got[t].coef for t in ("Alpha", "mkt", "smb")], inverse @ x.T @ y) and np.allclose([got[t].std_err for t in ("Alpha", "mkt", "smb")], errors)
        assert got["smb"].residual_vol == pytest.approx(left.std(ddof=1)) and got["smb"].r_squared == pytest.approx(1 - left @ left / ((y - y.mean()) ** 2).sum())
    parts = returns.factor_contributions(df, ["mkt", "smb"]).toPandas()
    assert np.allclose(parts.alpha + parts.mkt_part + parts.smb_part + parts.residual, parts.ret)


def test_trades(spark):
    rows = [("A", DAY(0), DAY(2), 1, 100.0, 110.0, 0.10), ("A", DAY(2), DAY(3), -1, 110.0, 104.5, 0.05), ("A", DAY(8), DAY(8), 1, 100.0, 90.0, -0.10)]
    log = spark.createDataFrame([(*r, "x" if r[3] > 0 else "y") for r in rows], "symbol string, entry_time date, exit_time date, direction int, entry_price double, exit_price double, `return` double, why string")
    prices = series(spark, [101, 105, 108, 104, 103, 103], "close")
    got = [r.ret for r in trades.trades_to_returns(log, prices).orderBy("ts").collect()]
    assert got[:2] == pytest.approx([0.01, 105 / 101 - 1]) and got[2] == pytest.approx((110 / 105) * (1 - (108 / 110 - 1)) - 1) and got[3] == pytest.approx(1 - (104.5 / 108 - 1) - 1) and got[4:6] == [0, 0]
    assert got[6] == pytest.approx(-0.1)
    assert [r.position for r in trades.trades_to_positions(log, prices).orderBy("ts").collect()] == [1, 1, 0, -1, 0, 0]
    stats = {r.group: r for r in trades.trade_stats(log, "why").collect()}
    assert stats["All"].trades == 3 and stats["All"].exposure == pytest.approx(3 / 8) and stats["All"].win_rate == pytest.approx(2 / 3) and stats["y"].trades == 1
    assert stats["All"].profit_factor == pytest.approx(1.5) and stats["All"].median_days == 1


def test_splits(spark):
    df = series(spark, range(10), "x")
    got = lambda d: [r.partition for r in d.orderBy("ts").collect()]
    assert got(splits.temporal_split(df, sizes={"train": 0.55, "test": 0.45})) == ["train"] * 5 + ["test"] * 5
    assert got(splits.temporal_split(df, DAY(3), DAY(5), DAY(7))) == ["train"] * 4 + ["validation"] * 2 + ["test"] * 2 + ["excluded"] * 2
    folds = splits.walk_forward(df, 3, gap=1)
    for k, (train, test) in enumerate(splits.timeseries_bounds(10, 3, gap=1)):
        want = ["train" if i in train else "test" if i in test else "excluded" for i in range(10)]
        assert got(folds.where(F.col("fold") == k)) == want
    purged = splits.purged_walk_forward(df.withColumn("label_end", F.date_add("ts", 2)), n_splits=3, embargo=1)
    assert got(purged.where("fold = 2")) == ["train"] * 5 + ["excluded"] * 3 + ["test"] * 2
    assert all(r.passed for r in splits.audit_splits(purged).collect())
    leaky = splits.walk_forward(df, 3).withColumn("label_end", F.date_add("ts", 2))
    assert not any(r.label_horizons_clear for r in splits.audit_splits(leaky).collect())
    z = splits.standardized(splits.temporal_split(series(spark, [0, 2, 4, 100, 200, 300], "x"), DAY(2)), ["x"]).where("partition = 'train'").toPandas()
    assert z.x.mean() == pytest.approx(0) and z.x.std(ddof=0) == pytest.approx(1)


def test_dataset(spark, tmp_path):
    x = series(spark, [1, 2, 3, 4], "momentum")
    y = series(spark, [0, 1, 0, 1], "target")
    data = splits.Dataset.of(("symbol", "ts"), x=x, y=y).with_split("s", splits.temporal_split(x, DAY(1)))
    assert data.partition("train", "s").count() == 2 and data.select("x", start=DAY(2)).columns == ["symbol", "ts", "momentum"]
    data.save(str(tmp_path / "d"))
    back = splits.Dataset.load(spark, str(tmp_path / "d"))
    assert back.roles == data.roles and back.partition("test", "s").count() == 2
    with pytest.raises(ValueError, match="differ"):
        splits.Dataset.of(("symbol", "ts"), x=x, y=y.limit(3))


def test_curves(spark):
    rows = [("a", 0.9, 0.1), ("a", 0.8, 0.2), ("b", 0.3, 0.7), ("b", 0.2, 0.8)]
    df = spark.createDataFrame(rows, "y string, sa double, sb double")
    roc = classification.roc_curve(df, "y", {"a": "sa", "b": "sb"})
    assert {r.auc for r in roc.collect()} == {1.0}
    assert {r.average_precision for r in classification.precision_recall_curve(df, "y", {"a": "sa", "b": "sb"}).collect()} == {1.0}
    assert [(r.fpr, r.tpr) for r in classification.macro_roc(roc).orderBy("fpr").collect()][0] == (0.0, 1.0)
    ties = spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.5, 0.5)], "y string, sa double, sb double")
    assert {r.auc for r in classification.roc_curve(ties, "y", {"a": "sa", "b": "sb"}).collect()} == {0.5}


def test_vectors(spark):
    rows = [("old", [1.0, 0.0], "2025-01-01", '{"k": "x"}'), ("future", [1.0, 0.1], "2026-01-01", '{"k": "x"}'), ("far", [0.0, 1.0], "2025-02-01", '{"k": "y"}')]
    index = spark.createDataFrame(rows, "id string, vector array<double>, published_at string, metadata_json string")
    assert [r.id for r in vector.search(index, [1.0, 0.0], as_of="2025-06-01", limit=2).collect()] == ["old", "far"]
    assert [r.id for r in vector.search(index, [1.0, 0.0], limit=2, where={"k": "y"}).collect()] == []
    assert vector.delete(index, ["old"]).count() == 2
    text = spark.createDataFrame([("s", " ".join(f"w{i}" for i in range(20))), ("e", ""), ("n", None)], "source_id string, text string")
    got = vector.chunked(text, size=8, overlap=2).orderBy("position").collect()
    assert [r.chunk.split()[0] for r in got] == ["w0", "w6", "w12"] and got[-1].chunk.split()[-1] == "w19"


def test_simulations(spark):
    df = series(spark, [0.01, -0.02, 0.03, 0.0])
    real = list(np.cumprod(1 + np.array([0.01, -0.02, 0.03, 0.0])) - 1)
    for paths in (simulate.montecarlo(df, 4, seed=3), simulate.montecarlo(df, 4, seed=3, block_size=2), simulate.noise_test(df, 4)):
        assert [r.path for r in paths.where("sim = 0").orderBy("step").collect()] == pytest.approx(real)
    still = simulate.noise_test(df, 3, noise=0).groupBy("step").agg(F.countDistinct("path").alias("n"))
    assert {r.n for r in still.collect()} == {1}
    got = simulate.outcomes(simulate.variance_test(df, 50, 30), bust=-1.0, goal=-0.99).first()
    assert got.goal_probability == 1 and got.bust_probability == 0


def test_replay(spark):
    df = spark.createDataFrame([("A", DAY(i), r, p) for i, (r, p) in enumerate(((0.0, 0.0), (0.0, 1.0), (0.1, 1.0), (-0.05, -1.0)))], "symbol string, ts date, ret double, position double")
    got = simulate.replay(df, cost=0.01).orderBy("ts").collect()
    assert [r.turnover for r in got] == [0, 1, 0, 2] and got[-1].equity == pytest.approx(0.99 * 1.1 * (1 + 0.05 - 0.02))


def test_environment(spark):
    from tidemark.operators.env import FinancialEnv

    df = spark.createDataFrame([(i, r, float(i)) for i, r in enumerate((0.0, 0.0, 0.1, -0.05))], "ts int, ret double, signal double")
    env = FinancialEnv(df, features=("signal",), cost=0.01)
    seen, _ = env.reset()
    assert seen == [(0.0,)] and env.feature_names() == ("signal",)
    for position, reward, over in ((1.0, -0.01, False), (1.0, 0.1, False), (-1.0, 0.03, True)):
        _, got, broke, ended, _ = env.step(position)
        assert got == pytest.approx(reward) and not broke and ended == over
    assert env.account().equity == pytest.approx(0.99 * 1.1 * 1.03) and "step 3" in env.render()
    with pytest.raises(RuntimeError):
        env.step(0)
    ruin = FinancialEnv(df, max_drawdown=0.04)
    ruin.reset(start=3)
    assert ruin.step(1)[2]
