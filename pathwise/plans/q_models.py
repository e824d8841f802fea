"""Registered queries: model training and batch inference.

Model outputs depend on Spark ML's randomness and tree internals, so these
are rows-checked here; ``tests/test_models.py`` holds the forest, permutation
importance, factors and content vectors to small cases.  M15's artefacts (bandit state, bigrams)
are SQL-checked through f07 / f06.
"""

from __future__ import annotations

from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from pathwise.functions import constants as K
from pathwise.operators import evaluation as EV
from pathwise.operators import events as EVT
from pathwise.operators import models as M
from pathwise.operators import scoring as S
from pathwise.plans import common as C
from pathwise.plans.catalog import register
from pathwise.sources import tables

LABEL = "final_score"
INPUT_FEATURES = ["attendance", "assignment_score", "quiz_score", "time_spent_hours", "attempts",
                  "previous_score", "engagement_score"]


def training_frame(spark, sf):
    f = EVT.hash_split(C.features(spark, sf), "student_id")
    return f.select("student_id", *[c for c in K.NUMERIC_FEATURES], LABEL, "is_train",
                    "subject_strength", "subject_weakness")


def labelled_frame(spark, sf):
    """The training frame's learners with a label: others can neither train nor measure a model."""
    return M.labelled(training_frame(spark, sf), LABEL)


def _rf(n=40, d=8):
    return M.random_forest(LABEL, K.NUMERIC_FEATURES, num_trees=n, max_depth=d)


@register("m01_random_forest")
def m01(spark, sf):
    d = training_frame(spark, sf)
    model = M.fit_trees(_rf(), d.filter("is_train"))
    return M.predict(model, d.filter("NOT is_train")).select("student_id", LABEL, "prediction")


@register("m02_m03_gbt_early_stopping")
def m02(spark, sf):
    d = training_frame(spark, sf)
    tr = d.filter("is_train").withColumn("is_valid", F.conv(F.substring(F.md5(
        F.concat(F.lit("v:"), F.col("student_id").cast("string"))), 1, 4), 16, 10).cast("int") % 5 == 0)
    model = M.fit_trees(M.gradient_boosting(LABEL, K.NUMERIC_FEATURES, max_iter=40, validation_col="is_valid"), tr)
    return M.predict(model, d.filter("NOT is_train")).select("student_id", LABEL, "prediction")


@register("m04_stacking")
def m04(spark, sf):
    d = training_frame(spark, sf).filter("is_train").drop("is_train", "subject_strength", "subject_weakness")
    est = {"rf": _rf(20, 6), "gbt": M.gradient_boosting(LABEL, K.NUMERIC_FEATURES, max_iter=20, max_depth=4)}
    bases, meta, _oof = M.stacking(d, "student_id", LABEL, K.NUMERIC_FEATURES, est, folds=3)
    test = training_frame(spark, sf).filter("NOT is_train").drop("is_train", "subject_strength", "subject_weakness")
    return M.stack_predict(bases, meta, test).select("student_id", LABEL, "prediction")


@register("m05_grid_search")
def m05(spark, sf):
    d = training_frame(spark, sf).filter("is_train")
    pipe = _rf(20, 6)
    rf = pipe.getStages()[-1]
    grid = ParamGridBuilder().addGrid(rf.numTrees, [10, 20]).addGrid(rf.maxDepth, [4, 6]).build()
    return M.grid_search(d, pipe, grid, LABEL, folds=3)


@register("m06_f28_repeated_kfold")
def m06(spark, sf):
    d = training_frame(spark, sf)
    per = M.kfold_metrics(d, "student_id", LABEL, _rf(20, 6), folds=3, repeats=2)
    return EV.cv_summary(per, ["rmse", "mae", "r2"])


@register("m07_learning_curve")
def m07(spark, sf):
    return M.learning_curve(labelled_frame(spark, sf), "student_id", LABEL, _rf(10, 5))


@register("m08_m09_permutation_importance")
def m08(spark, sf):
    d = labelled_frame(spark, sf).persist()  # read by every fit
    model = M.fit_trees(_rf(20, 6), d.filter("is_train"))
    imp = M.permutation_importance(model, d.filter("NOT is_train"), "student_id", LABEL,
                                   K.NUMERIC_FEATURES)
    best = M.refit_on_subset(lambda cols: M.random_forest(LABEL, cols, 20, 6), model, d.filter("is_train"), d.filter("NOT is_train"),
                             LABEL, K.NUMERIC_FEATURES, imp)
    d.unpersist()
    return imp.select("*", F.col("feature").isin(best["features"]).alias("selected"), F.lit(best["rmse_all"]).alias("rmse_all"),
                      F.lit(best["rmse_subset"]).cast("double").alias("rmse_subset"), F.lit(best["kept_subset"]).alias("kept_subset"))


_CLUSTER = ["engagement_score", "consistency_score", "learning_efficiency"]


@register("m10_m11_kmeans_segments")
def m10(spark, sf):
    f = C.features(spark, sf)
    km, names = M.kmeans_segments(f, _CLUSTER, 3)
    return M.enrich(f.select("student_id", *_CLUSTER), km, names, _CLUSTER).select(
        "student_id", "cluster", "cluster_label")


@register("m12_implicit_factors")
def m12(spark, sf):
    ev = C.rated_events(spark, sf).filter(F.col("item_id").isNotNull()).withColumn(
        "interaction_weight", S.interaction_weight("event_type"))
    uf, itf = M.implicit_factors(ev, "user_id", "item_id", "interaction_weight")
    side = lambda df, name, key: df.select(F.lit(name).alias("side"), F.col(key).cast("string").alias("id"), "vector")
    return side(uf, "user", "user_id").unionByName(side(itf, "item", "item_id"))


@register("m13_content_vectors")
def m13(spark, sf):
    docs = tables.read_table(spark, sf, "documents").select("doc_id", "text")
    return M.content_vectors(docs, "doc_id", "text", k=16)


@register("m14_batch_score")
def m14(spark, sf):
    d = training_frame(spark, sf)
    model = M.fit_trees(M.random_forest(LABEL, INPUT_FEATURES, num_trees=20, max_depth=6), d.filter("is_train"))
    return M.batch_score(model, d).select("student_id", "predicted_score", "risk_level")
