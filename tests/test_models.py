import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from pathwise.operators import models as M
from pathwise.operators import ranking as R
from pathwise.plans import common as C
from pathwise.plans import q_jobs as QJ
from pathwise.plans import q_models as QM


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 0.3, 300)
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "id long, a double, b double, c double, y double").cache()


def test_forest_beats_the_mean_and_repeats(frame):
    fit = lambda: M.rmse(M.random_forest("y", ["a", "b", "c"], num_trees=10, max_depth=5).fit(frame).transform(frame), "y")
    spread = frame.agg(F.stddev_pop("y")).first()[0]
    assert fit() < 0.6 * spread and fit() == fit()


def test_permutation_finds_the_used_columns(frame):
    model = M.random_forest("y", ["a", "b", "c"], num_trees=10, max_depth=5).fit(frame)
    got = {r.feature: r.importance_mean for r in M.permutation_importance(model, frame, "id", "y", ["a", "b", "c"], 2).collect()}
    assert got["a"] > 5 * abs(got["c"]) and got["b"] > 5 * abs(got["c"])
    moved = M.permute_column(frame, "id", "a", 0)
    assert sorted(r.a for r in moved.collect()) == sorted(r.a for r in frame.collect())


def test_factors_of_any_ids(spark):
    rows = [(2 ** 40 + u, f"item{i}", 1.0 + (u % 2 == i % 2)) for u in range(12) for i in range(8) if (u + i) % 3]
    users, items = M.implicit_factors(spark.createDataFrame(rows, "u long, i string, w double"), "u", "i", "w", rank=3, iters=3)
    assert {r.u for r in users.collect()} == {r[0] for r in rows}
    assert {r.i for r in items.collect()} == {r[1] for r in rows} and all(len(r.vector) == 3 for r in items.collect())


def test_content_vectors_tell_texts_apart(spark):
    rows = [(i, ("river lake water ocean " if i % 2 else "engine motor wheel brake ") * 5) for i in range(10)]
    got = {r.d: np.asarray(r.vector) for r in M.content_vectors(spark.createDataFrame(rows, "d long, t string"), "d", "t", k=2, width=64).collect()}
    assert np.linalg.norm(got[0] - got[2]) < 1e-6 < np.linalg.norm(got[0] - got[1])


def test_registered_model_queries_do_the_operators_whole_job(spark, monkeypatch):
    from pathwise.functions import constants as K
    from pathwise.plans import q_models as Q
    from conftest import SF
    asked = {}
    monkeypatch.setattr(M, "permutation_importance", lambda model, df, key, label, cols, repeats=5: asked.update(
        cols=list(cols), repeats=repeats) or spark.createDataFrame([(c, 1.0, 0.0) for c in cols], "feature string, importance_mean double, importance_std double"))
    curve = M.learning_curve
    monkeypatch.setattr(M, "learning_curve", lambda *a, **kw: asked.update(curve=kw) or a[0])
    assert Q.m08(spark, SF).count() == len(K.NUMERIC_FEATURES) and asked["repeats"] == 5 and asked["cols"] == K.NUMERIC_FEATURES
    Q.m07(spark, SF)
    assert asked["curve"] == {} and len(curve.__defaults__[0]) == 6 and curve.__defaults__[1] == 5
    frame = Q.training_frame(spark, SF)
    monkeypatch.setattr(Q, "training_frame", lambda *a: frame.withColumn(Q.LABEL, F.when(F.col("student_id") % 7 > 0, F.col(Q.LABEL))))
    assert Q.m08(spark, SF).count() == len(K.NUMERIC_FEATURES) and Q.m07(spark, SF).filter(F.col(Q.LABEL).isNull()).count() == 0
    rows = Q.m12(spark, SF).collect()
    assert {r.side for r in rows} == {"user", "item"} and all(len(r.vector) == 32 for r in rows)
    assert len({(r.side, r.id) for r in rows}) == len(rows)


def test_subset_is_kept_only_if_not_worse(spark, frame):
    build = lambda cols: M.random_forest("y", cols, num_trees=10, max_depth=5)
    train, test = frame.filter("id % 3 > 0"), frame.filter("id % 3 = 0")
    model = build(["a", "b", "c"]).fit(train)
    table = lambda **x: spark.createDataFrame(list(x.items()), "feature string, importance_mean double")
    useless = M.refit_on_subset(build, model, train, test, "y", ["a", "b", "c"], table(a=0.0, b=-1.0, c=1.0), least=2)
    assert not useless["kept_subset"] and useless["features"] == ["a", "b", "c"] and useless["model"] is model
    assert useless["rmse_subset"] > useless["rmse_all"]
    whole = M.refit_on_subset(build, model, train, test, "y", ["a", "b", "c"], table(a=3.0, b=2.0, c=1.0), least=2)
    assert whole["features"] == ["a", "b", "c"] and whole["kept_subset"] and whole["rmse_subset"] == whole["rmse_all"]
    none = M.refit_on_subset(build, model, train, test, "y", ["a", "b", "c"], table(a=0.0), least=2)
    assert none["rmse_subset"] is None and not none["kept_subset"]
    assert M.refit_on_subset(build, model, train, test, "y", ["a", "b", "c"], table(a=1.0))["rmse_subset"] is None  # few columns


def test_rows_without_a_label_neither_train_nor_measure(spark, frame):
    """A learner without orders has no label; Spark ML refuses to fit such rows."""
    holes = frame.unionByName(spark.createDataFrame([(900 + i, 0.1, 0.2, 0.3, y) for i, y in enumerate((None, float("nan")) * 4)],
                                                    frame.schema))
    cols = ["a", "b", "c"]
    forest = M.random_forest("y", cols, num_trees=4, max_depth=3)
    assert M.kfold_metrics(holes, "id", "y", forest, folds=2).collect() == M.kfold_metrics(frame, "id", "y", forest, folds=2).collect()
    grid = ParamGridBuilder().addGrid(forest.getStages()[-1].maxDepth, [2, 3]).build()
    assert M.grid_search(holes, forest, grid, "y", folds=2).count() == 2
    bases, meta, oof = M.stacking(holes, "id", "y", cols, {"rf": forest}, folds=2)
    assert oof.count() == 300
    assert M.stack_predict(bases, meta, holes.na.drop(subset=["y"])).count() == 300


@pytest.mark.parametrize("job", [QM.m01, QM.m02, QM.m04, QM.m05, QM.m06, QM.m14, QJ.j02, QJ.j08, QJ.j09, QJ.j13])
def test_jobs_take_learners_without_orders(spark, monkeypatch, job):
    rng = np.random.default_rng(9)
    base = C.learners(spark, SF).limit(60).toPandas()
    base = pd.concat([base.assign(student_id=np.arange(60) + 60 * i, quiz_score=rng.uniform(0, 100, 60)) for i in range(2)])
    base.loc[base["student_id"] % 6 == 0, ["attendance", "assignment_score", "previous_score"]] = None
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in base.itertuples(index=False)]
    learners = spark.createDataFrame(rows, C.learners(spark, SF).schema).persist()
    monkeypatch.setattr(C, "learners", lambda *a: learners)
    assert C.features(spark, SF).filter("final_score IS NULL").count() == 20
    got = job(spark, SF)
    assert got.count() > 0
    if job in (QM.m14, QJ.j02):
        assert got.count() == 120  # learners without a label are scored as well
    learners.unpersist()


def counted(df, col, kind):
    """``df`` with a counter of how often ``col`` is computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)
    same = F.udf(lambda x: seen.add(1) or x, kind).asNondeterministic()
    return df.withColumn(col, same(col)), seen


def test_fits_and_repeats_read_the_table_once(spark, frame):
    cols = ["a", "b", "c"]
    forest = M.random_forest("y", cols, num_trees=3, max_depth=3)
    table, seen = counted(frame, "a", "double")
    curve = M.learning_curve(table, "id", "y", forest, sizes=(0.5, 1.0), folds=2).collect()
    assert seen.value == frame.count() and [r.train_share for r in curve] == [0.5, 1.0]
    model = forest.fit(frame)
    table, seen = counted(frame, "a", "double")
    got = {r.feature: r.importance_mean for r in M.permutation_importance(model, table, "id", "y", cols, 2).collect()}
    assert seen.value == frame.count()
    base = M.rmse(model.transform(frame), "y")
    for c in cols:
        want = [M.rmse(model.transform(M.permute_column(frame, "id", c, r)), "y") - base for r in range(2)]
        assert got[c] == pytest.approx(sum(want) / 2, abs=1e-9)


def test_rows_that_miss_features_train_and_are_scored(spark, frame):
    """A learner with a label may lack a feature (no nation: no age); Spark ML refuses to fit such rows."""
    cols, nan, inf = ["a", "b", "c"], float("nan"), float("inf")
    holes = [(900 + i, x, 0.1 * i, y, 30.0) for i, (x, y) in enumerate([(None, 0.1), (nan, 0.2), (inf, None), (0.3, -inf)] * 10)]
    d = frame.unionByName(spark.createDataFrame(holes, frame.schema))
    forest = M.random_forest("y", cols, num_trees=4, max_depth=3)
    model = M.fit_trees(forest, d)
    got = {r.id: r.prediction for r in model.transform(d).collect()}
    assert len(got) == 340 and got == {r.id: r.prediction for r in model.transform(M.bounded(d, cols)).collect()}
    assert min(got[900 + i] for i in range(40) if i % 4 < 3) > np.mean([got[i] for i in range(300)])  # their rows were learned from
    assert M.fit_trees(forest, frame).stages[-1].toDebugString.split("\n")[1:] == forest.fit(frame).stages[-1].toDebugString.split("\n")[1:]
    boosted = M.gradient_boosting("y", cols, max_iter=2, max_depth=2)
    assert M.fit_trees(boosted, d).transform(d).count() == 340
    assert M.kfold_metrics(d, "id", "y", forest, folds=2).count() == 2 and M.learning_curve(d, "id", "y", forest, sizes=(1.0,), folds=2).count() == 1
    assert M.grid_search(d, forest, ParamGridBuilder().addGrid(forest.getStages()[-1].maxDepth, [2, 3]).build(), "y", folds=2).count() == 2
    assert R.learned_ranker(d, "y", cols, 2, 2).transform(d).count() == 340
    some = d.filter("NOT abs(coalesce(c, 0)) = double('inf') AND NOT coalesce(a, 0) = double('inf')")
    bases, meta, oof = M.stacking(some, "id", "y", cols, {"rf": forest}, folds=2)
    scored = M.stack_predict(bases, meta, some).collect()
    assert oof.count() == len(scored) == 320 and np.isfinite([r.prediction for r in scored]).all()
    assert set(scored[0].asDict()) == {"id", "y", *cols, "oof_rf", "prediction"}


def test_stacking_computes_its_table_once(spark, frame):
    table, seen = counted(frame, "a", "double")
    M.stacking(table, "id", "y", ["a", "b", "c"], {"rf": M.random_forest("y", ["a", "b", "c"], num_trees=2, max_depth=2)}, folds=2)
    assert seen.value == frame.count()


def test_texts_are_read_once(spark):
    docs, seen = counted(spark.createDataFrame([(i, f"alpha beta w{i % 5} w{i % 3}") for i in range(30)], "d long, t string"), "t", "string")
    assert M.content_vectors(docs, "d", "t", k=2, width=32).count() == 30
    assert seen.value == 30


def test_quality_report_has_every_metric(spark, monkeypatch):
    """The report's MAPE and within-10 share were computed and then dropped."""
    forest, boosted = M.random_forest, M.gradient_boosting
    monkeypatch.setattr(M, "random_forest", lambda y, cols, *a, **b: forest(y, cols, num_trees=3, max_depth=3))
    monkeypatch.setattr(M, "gradient_boosting", lambda y, cols, *a, **b: boosted(y, cols, max_iter=2, max_depth=2))
    want = {r["model"]: r.asDict() for r in QJ.j08(spark, SF).collect()}
    got = {(r["model"], r["metric"]): r for r in QJ.j13(spark, SF).collect()}
    assert got.keys() == {(m, x) for m in want for x in ("rmse", "mae", "r2", "mape", "within_10")}
    for (m, x), r in got.items():
        assert r["value"] == pytest.approx(want[m][x]) and r["delta"] == pytest.approx(r["value"] - r["previous_value"])
    assert all(0 < got[m, "within_10"]["value"] <= 1 for m in want)
