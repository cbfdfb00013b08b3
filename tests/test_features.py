"""Scaling, encoding, selection, splits, models, training and inference jobs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtide.operators import encoding, models, scoring, selection, splitting
from loomtide.plans.inference import run_inference
from loomtide.plans.training import TrainingConfig, run_training


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        signal, noise = float(rng.normal()), float(rng.uniform(0, 100))
        rows.append((i, signal, noise, 7.0, "ABCD"[i % 4], int(signal + rng.normal() * 0.3 > 0), 3 * signal + 5))
    return spark.createDataFrame(rows, "id int, signal double, noise double, flat double, cat string, target int, y double")


def test_constant_and_missing_values(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, None), (5.0, 3.0)], "flat double, x double")
    for strategy in encoding.SCALERS:
        rows = encoding.Preprocessor(numeric_strategy=strategy).fit_transform(df).collect()
        assert [r["flat"] for r in rows] == [0.0, 0.0, 0.0]
        assert rows[1]["x"] is None


def test_widths_unknown_and_unfitted(spark, table):
    data = table.select("signal", "cat")
    wide = encoding.Preprocessor().fit(data)
    assert wide.output_names() == ["signal", "cat_B", "cat_C", "cat_D"]
    narrow = encoding.Preprocessor(categorical_strategy="label").fit(data)
    assert narrow.output_names() == ["signal", "cat"]
    new = spark.createDataFrame([(0.0, "Z"), (0.0, None)], "signal double, cat string")
    assert [list(r)[1:] for r in wide.transform(new).collect()] == [[0.0, 0.0, 0.0]] * 2
    assert [r["cat"] for r in narrow.transform(new).collect()] == [-1.0, -1.0]
    with pytest.raises(ValueError, match="not fitted"):
        encoding.Preprocessor().transform(data)
    with pytest.raises(ValueError, match="unknown numeric"):
        encoding.Preprocessor(numeric_strategy="odd")
    with pytest.raises(ValueError, match="max_wide"):
        encoding.Preprocessor(max_wide=3).fit(data)


def test_same_output_after_reload(spark, table, tmp_path):
    data = table.select("id", "signal", "cat")
    for options in ({}, {"categorical_strategy": "ordinal", "max_wide": 2}):
        prep = encoding.Preprocessor(numeric=["signal"], categorical=["cat"], **options).fit(data, exclude=["id"])
        path = str(tmp_path / f"prep{len(options)}")
        prep.save(spark, path)
        again = encoding.Preprocessor.load(spark, path)
        key = lambda rows: sorted(map(tuple, rows))
        assert key(again.transform(data, ["id"]).collect()) == key(prep.transform(data, ["id"]).collect())


def test_large_dictionary_is_sorted_rank(spark):
    names = sorted(f"n{i * 7919 % 1000:04d}" for i in range(1000))
    df = spark.createDataFrame([(n,) for n in names], "name string").union(spark.createDataFrame([(names[0],)], "name string"))
    got = {r["value"]: r["code"] for r in encoding.category_dictionary(df, "name").collect()}
    assert got == {n: i for i, n in enumerate(names)}


def test_selection_methods(table):
    feats = ["signal", "noise", "flat"]
    assert selection.select_features(table, feats, "target", "k_best", k=1) == ["signal"]
    assert selection.select_features(table, feats, "y", "k_best", task="regression", k=1) == ["signal"]
    assert selection.select_features(table, feats, "target", "mutual_info", k=1) == ["signal"]
    assert selection.select_features(table, feats, "target", "percentile", percentile=34) == ["signal"]
    assert selection.select_features(table, feats, "target", "rfe", k=1, n_estimators=5, max_depth=3) == ["signal"]
    with pytest.raises(ValueError, match="unknown selection"):
        selection.select_features(table, feats, "target", "odd")
    scores = selection.f_classif(table, feats, "target", with_p=True).collect()
    assert {r["feature"]: (r["p_value"] or 1) < 0.01 for r in scores} == {"signal": True, "noise": False, "flat": False}


def test_elimination_with_folds(table):
    kept = selection.select_features(
        table, ["signal", "noise"], "target", "rfecv", key="id", folds=2, n_estimators=4, max_depth=2
    )
    assert "signal" in kept


@pytest.mark.parametrize("n", [1, 7, 240])
def test_split_sizes_are_exact_and_repeatable(table, n):
    data = table.orderBy("id").limit(n)
    first = splitting.random_split(data, "id")
    assert first.where("split = 'test'").count() == math.ceil(n * 0.2)
    again = splitting.random_split(data.repartition(5), "id")
    assert sorted(map(tuple, first.select("id", "split").collect())) == sorted(map(tuple, again.select("id", "split").collect()))


def test_stratified_and_folds(table):
    parts = splitting.stratified_split(table, "id", "cat").groupBy("cat", "split").count().collect()
    assert {(r["split"], r["count"]) for r in parts} == {("test", 12), ("validation", 6), ("train", 42)}
    sizes = [r["count"] for r in splitting.cv_folds(table.limit(238), "id").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert splitting.repeatable_sample(table, "id", 1000).count() == 240
    assert [r["id"] for r in splitting.head(table, "id", 3).collect()] == [0, 1, 2]


@pytest.mark.parametrize("algorithm", ["random_forest", "logistic_regression", "boosted_trees"])
def test_classifiers(table, algorithm):
    params = {} if algorithm == "logistic_regression" else {"n_estimators": 4, "max_depth": 3}
    fitted = models.train(table, ["signal", "noise"], "target", "classification", algorithm, **params)
    rows = fitted.predict(table).collect()
    assert all(sum(r["probabilities"]) == pytest.approx(1.0) for r in rows)
    assert {type(r["prediction"]) for r in rows} == {int}
    got = models.evaluate(fitted, table).first()
    assert got["accuracy"] > 0.8 and got["roc_auc"] > 0.85


def test_boosted_trees_with_several_classes(table):
    fitted = models.train(table, ["signal", "noise"], "cat", "classification", "boosted_trees", n_estimators=2, max_depth=2)
    rows = fitted.predict(table.limit(20)).collect()
    assert all(sum(r["probabilities"]) == pytest.approx(1.0) and len(r["probabilities"]) == 4 for r in rows)
    with pytest.raises(ValueError):
        fitted.importance()


@pytest.mark.parametrize("algorithm", ["random_forest", "linear", "ridge", "lasso", "boosted_trees"])
def test_regressors(table, algorithm):
    params = {"n_estimators": 5, "max_depth": 4} if algorithm in ("random_forest", "boosted_trees") else {"alpha": 0.01}
    fitted = models.train(table, ["noise", "signal"], "y", "regression", algorithm, **params)
    assert models.evaluate(fitted, table).first()["r2"] > 0.8
    assert fitted.importance().first()["feature"] == "signal"


def test_intervals_and_reload(spark, table, tmp_path):
    fitted = models.train(table, ["signal", "noise"], "y", "regression", n_estimators=7, max_depth=4)
    rows = fitted.predict_interval(table).collect()
    assert all(r["lower_bound"] - 1e-9 <= r["prediction"] <= r["upper_bound"] + 1e-9 for r in rows)
    fitted.save(spark, str(tmp_path / "m"))
    again = models.TrainedModel.load(spark, str(tmp_path / "m"))
    assert [r["prediction"] for r in again.predict(table.orderBy("id")).collect()] == [
        r["prediction"] for r in fitted.predict(table.orderBy("id")).collect()
    ]
    with pytest.raises(ValueError):
        models.train(table, ["signal"], "target", "classification", "odd")


def test_training_then_inference(spark, table, tmp_path):
    data = table.select("id", "signal", "noise", "cat", "target")
    config = TrainingConfig("target", ["id"], params={"n_estimators": 5, "max_depth": 4}, selection="k_best", n_features=2)
    done = run_training(spark, data, config, "demo", str(tmp_path / "out"))
    assert done.test_metrics.first()["accuracy"] > 0.7 and len(done.model.features) == 2
    assert done.run.first()["metrics"]["accuracy"] == done.test_metrics.first()["accuracy"]
    scored = run_inference(spark, data, str(tmp_path / "out"), str(tmp_path / "scored.csv"), threshold=0.9)
    rows = scored.collect()
    assert len(rows) == 240 and rows[0]["cat"] in "ABCD"
    assert all((r["confident_prediction"] == -1.0) == (not r["is_confident"]) for r in rows)
    written = spark.read.option("header", True).csv(str(tmp_path / "scored.csv"))
    assert written.columns == [*data.columns, "predictions", "probability_class_0", "probability_class_1"]
    about = scoring.with_metadata(scored, done.model, F.lit("2024-01-01")).first()["value"]
    assert '"algorithm":"random_forest"' in about


def test_failed_validation_warns_or_stops(spark, table):
    broken = table.select("id", "signal", "target", F.when(F.col("id") > 3, F.col("noise")).alias("noise"))
    config = TrainingConfig("target", ["id"], algorithm="logistic_regression", fail_on_validation_error=True)
    with pytest.raises(ValueError, match="validation failed"):
        run_training(spark, broken, config, "strict")


def test_linear_folds_from_moments_are_those_of_refits(spark):
    from loomtide.operators import splitting

    rng = np.random.default_rng(8)
    x = rng.normal(1000, 3, (300, 3))
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 1, 300)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(300)] + [(900, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    got = {r["fold"]: r for r in models.cross_validate_linear(df, "id", ["a", "b", "c"], "y", folds=4).collect()}
    fold = {r["id"]: r["fold"] for r in splitting.cv_folds(df, "id", 4).collect() if r["id"] != 900}
    of = np.array([fold[i] for i in range(300)])
    for f in range(4):
        design = np.c_[np.ones((of != f).sum()), x[of != f]]
        w = np.linalg.lstsq(design, y[of != f], rcond=None)[0]
        e = y[of == f] - np.c_[np.ones((of == f).sum()), x[of == f]] @ w
        assert got[f]["n"] == (of == f).sum() and got[f]["mse"] == pytest.approx((e**2).mean(), rel=1e-6)
        assert got[f]["r2"] == pytest.approx(1 - (e**2).mean() / y[of == f].var(), rel=1e-6)
    order = {r["feature"]: r["rank"] for r in models.linear_elimination(df, ["a", "b", "c"], "y").collect()}
    assert order == {"a": 1, "b": 2, "c": 3}
    assert models.cross_validate_linear(df.limit(0), "id", ["a"], "y").count() == 0


def test_a_split_is_searched_for_once(table, capsys):
    from loomtide.operators import splitting

    splitting.random_split(splitting.cv_folds(table, "id", 3), "id").explain()
    plan = capsys.readouterr().out
    assert "Scan" in plan and "Join" not in plan and "Aggregate" not in plan
    splitting.stratified_split(table, "id", "cat").explain()
    assert "Window" not in capsys.readouterr().out
    parts = splitting.written_parts(splitting.random_split(table, "id"), ["train", "test"])
    assert [p.count() for p in parts] == [192, 48] and all(p.columns == table.columns for p in parts)
    parts[0].explain()
    assert "md5" not in capsys.readouterr().out
    empty = table.limit(0)
    assert splitting.cv_folds(empty, "id").count() == 0 and splitting.stratified_split(empty, "id", "cat").count() == 0


def test_cuts_at_every_rank(spark):
    from loomtide.operators import splitting

    df = spark.range(40).selectExpr("id", "id % 3 as g").where("g < 2 or id = 2")
    hashed = df.select("g", splitting.row_hash("id", 42).alias("_hash"))
    found = splitting._cut_hashes(hashed, ["g"], lambda n: [n * 0, F.lit(1), F.floor(n / 2), n])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range") == 2
    hashes = {}
    for r in hashed.collect():
        hashes.setdefault(r["g"], []).append(r["_hash"])
    for r in found.collect():
        of = sorted(hashes[r["g"]])
        assert r["_cuts"] == sorted(["", of[0], of[len(of) // 2 - 1] if len(of) > 1 else "", of[-1]])


def test_linear_cross_validation_fits_all_folds_at_once(spark, monkeypatch):
    from loomtide.operators import splitting

    rng = np.random.default_rng(11)
    # the second column is tiny, the third constant
    x = np.c_[rng.normal(1e6, 1e5, 200), rng.normal(0, 1e-5, 200), np.full(200, 3.0)]
    y = 1e-5 * x[:, 0] + 2e5 * x[:, 1] + rng.normal(0, 0.1, 200)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 3.0, 1.0), (901, 1.0, 1.0, 3.0, None), (902, float("nan"), 1.0, 3.0, 1.0)],
                               "id long, a double, b double, c double, y double")
    fold = {r["id"]: r["fold"] for r in splitting.cv_folds(df, "id", 3).collect()}
    monkeypatch.setattr(models, "train", None)
    out = models.cross_validate(df, "id", ["a", "b", "c"], "y", "regression", "linear", folds=3)
    assert out.columns == ["n", "mse", "rmse", "mae", "r2", "mape", "fold"]
    got, of = {r["fold"]: r for r in out.collect()}, np.array([fold[i] for i in range(200)])
    z = (x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0)
    for f in range(3):
        inside = of == f
        w = np.linalg.lstsq(np.c_[np.ones((~inside).sum()), z[~inside]], y[~inside], rcond=None)[0]
        e = y[inside] - np.c_[np.ones(inside.sum()), z[inside]] @ w
        assert got[f]["n"] == inside.sum()
        for name, value in (("mse", (e**2).mean()), ("mae", np.abs(e).mean()), ("r2", 1 - (e**2).mean() / y[inside].var())):
            assert got[f][name] == pytest.approx(value, rel=1e-6)
    few = models.cross_validate(df.where("id < 2"), "id", ["a"], "y", "regression", "linear", folds=3).collect()
    assert sorted((r["fold"], r["n"]) for r in few) == [(0, 1), (1, 1), (2, 0)]


def test_bracketed_quantiles_of_groups_and_columns(spark):
    from loomtide.operators import ordered as o

    rng = np.random.default_rng(9)
    big = np.round(rng.exponential(50, 20_000), 1)
    other = rng.integers(0, 3, 20_000).astype(float)
    rows = [("big", float(a), float(b)) for a, b in zip(big, other)]
    small = {None: [3.0], "two": [1.0, 2.0], "none": [None, None]}
    rows += [(g, v, 1.0) for g, vs in small.items() for v in vs] + [("big", float("nan"), None)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    wanted = {"p0": 0.0, "p1": 0.001, "p50": 0.5, "p95": 0.95, "p999": 0.9995, "p100": 1.0}
    for hot_rows in (10**9, 10):
        got = {(r["g"], r["column_name"]): r for r in o.bracketed_quantiles(df, ["g"], ["a", "b"], wanted, hot_rows).collect()}
        assert len(got) == 8
        for name, p in wanted.items():
            assert got["big", "a"][name] == pytest.approx(np.quantile(big, p)) and got["big", "b"][name] == np.quantile(other, p)
            assert got[None, "a"][name] == 3.0 and got["two", "a"][name] == 1.0 + p and got["none", "a"][name] is None
    # only values near the wanted ranks are sorted
    plan = o.bracketed_quantiles(df, [], ["a"], {"m": 0.5})
    assert plan.first()["m"] == pytest.approx(np.median(np.append(big, [3.0, 1.0, 2.0])))
