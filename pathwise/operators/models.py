"""Distributed training and batch inference (M1-M14) with Spark ML.

Feature columns stay relational until the ML boundary, where one
``VectorAssembler`` builds the vector.  Folds come from the md5 fold column
(W7), so every fit/score is reproducible and partition-independent.
Driver-side loops run over folds, grid points or features - never over data.
"""

from __future__ import annotations

import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (IDF, PCA, HashingTF, Imputer, NGram, RegexTokenizer, StopWordsRemover,
                                VectorAssembler)
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.functions.expressions import clip
from pathwise.operators.events import fold_assignment
from pathwise.operators.scoring import risk_level
from pathwise.session import scratch_path


def assembler(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def random_forest(label: str, cols: list[str], num_trees: int = 400, max_depth: int = 12,
                  min_instances: int = 1, seed: int = 42) -> Pipeline:
    """M1: random-forest regressor pipeline."""
    rf = RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=num_trees, maxDepth=max_depth,
                               minInstancesPerNode=min_instances, seed=seed)
    return Pipeline(stages=[assembler(cols), rf])


def gradient_boosting(label: str, cols: list[str], max_iter: int = 100, max_depth: int = 5,
                      step: float = 0.1, validation_col: str | None = None, seed: int = 42) -> Pipeline:
    """M2 (+M3 with ``validation_col``: early stopping on the flagged rows)."""
    kw = {"validationIndicatorCol": validation_col} if validation_col else {}
    g = GBTRegressor(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth,
                     stepSize=step, seed=seed, **kw)
    return Pipeline(stages=[assembler(cols), g])


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction", lo: float = 0, hi: float = 100) -> DataFrame:
    """M14 core: transform and clip the prediction."""
    return model.transform(df).withColumn(out, clip(F.col("prediction"), lo, hi)).drop("features")


def batch_score(model: PipelineModel, df: DataFrame, upper_inclusive: bool = True) -> DataFrame:
    """Predicted score (clip 0..100) and risk band (C2 by default)."""
    p = predict(model, df, "predicted_score")
    return p.withColumn("risk_level", risk_level("predicted_score", upper_inclusive))


def labelled(df: DataFrame, label: str) -> DataFrame:
    """The rows with a label: others can neither train nor measure a model (Spark ML refuses a null or NaN label)."""
    return df.filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))


ABOVE_ALL = 1e300  # lies right of every threshold, where trees also send NaN when they score


def bounded(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing values of ``cols`` at ``ABOVE_ALL`` and infinite ones at the bounds: tree learners refuse both, scoring does not.

    Every split treats these as it treats NaN and infinities in scoring, so a model needs no filled table to predict.
    """
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    return df.withColumns({c: F.least(F.greatest(value(c), F.lit(-ABOVE_ALL)), F.lit(ABOVE_ALL)) for c in cols})  # NaN is above all numbers


def fit_trees(pipeline: Pipeline, df: DataFrame) -> PipelineModel:
    """Fit an M1 or M2 pipeline on every row with a label, also those that miss features (see :func:`bounded`)."""
    first, last = pipeline.getStages()[0], pipeline.getStages()[-1]
    return pipeline.fit(bounded(labelled(df, last.getLabelCol()), first.getInputCols()))


def rmse(df: DataFrame, label: str, pred: str = "prediction") -> float:
    return RegressionEvaluator(labelCol=label, predictionCol=pred, metricName="rmse").evaluate(df)


def oof_predictions(df: DataFrame, key: str, label: str, estimators: dict, folds: int = 5,
                    seed: str = "42") -> DataFrame:
    """M4 part 1: out-of-fold predictions of each base estimator (one column per model)."""
    d = fold_assignment(labelled(df, label), key, folds, seed)
    out = None
    for f in range(folds):
        tr, va = d.filter(F.col("fold") != f), d.filter(F.col("fold") == f)
        preds = va.select(key, label, *[c for c in df.columns if c not in (key, label)])
        for name, est in estimators.items():
            m = fit_trees(est, tr)
            preds = m.transform(preds).withColumnRenamed("prediction", f"oof_{name}").drop("features")
        out = preds if out is None else out.unionByName(preds)
    return out


def stacking(df: DataFrame, key: str, label: str, cols: list[str], estimators: dict,
             alphas=(0.1, 1.0, 3.0, 10.0), folds: int = 5, parallelism: int = 4):
    """M4: ridge meta-model over out-of-fold predictions plus the raw features
    (passthrough); the ridge strength is chosen by cross-validation.

    ``alphas`` penalise the summed squared loss of unscaled features; Spark's
    ``regParam`` penalises its mean, so the grid is divided by the row count.
    The linear model takes the training mean for a missing feature.
    Returns (base models fitted on all rows, meta model, oof frame).
    """
    df = labelled(df, label).persist()  # read by every fit
    oof = oof_predictions(df, key, label, estimators, folds).persist()  # read by every fit and measure of the meta-model
    filled = [f"__filled_{c}" for c in cols]
    means = Imputer(inputCols=cols, outputCols=filled, strategy="mean")
    meta_cols = [f"oof_{n}" for n in estimators] + filled
    lr = LinearRegression(labelCol=label, featuresCol="features", elasticNetParam=0.0, standardization=False)
    try:
        n = max(1, df.count())
        grid = ParamGridBuilder().addGrid(lr.regParam, [a / n for a in alphas]).build()
        cv = CrossValidator(estimator=Pipeline(stages=[means, assembler(meta_cols), lr]), estimatorParamMaps=grid,
                            evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"),
                            numFolds=3, seed=42, parallelism=parallelism)
        meta = cv.fit(oof)
        bases = {n: fit_trees(e, df) for n, e in estimators.items()}
    finally:
        oof.unpersist()
        df.unpersist()
    return bases, meta, oof


def stack_predict(bases: dict, meta, df: DataFrame) -> DataFrame:
    d = df
    for n, m in bases.items():
        d = m.transform(d).withColumnRenamed("prediction", f"oof_{n}").drop("features")
    out = meta.transform(d)
    return out.drop("features", *[c for c in out.columns if c.startswith("__filled_")])


def grid_search(df: DataFrame, pipeline: Pipeline, grid, label: str, folds: int = 3,
                metric: str = "rmse", parallelism: int = 4) -> DataFrame:
    """M5: cross-validated grid search; one row per grid point with its mean metric."""
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, numFolds=folds, seed=42,
                        evaluator=RegressionEvaluator(labelCol=label, metricName=metric), parallelism=parallelism)
    m = cv.fit(bounded(labelled(df, label), pipeline.getStages()[0].getInputCols()))
    rows = []
    for i, (pm, v) in enumerate(zip(grid, m.avgMetrics)):
        rows.append((i, ";".join(f"{p.name}={val}" for p, val in sorted(pm.items(), key=lambda x: x[0].name)), float(v)))
    return df.sparkSession.createDataFrame(rows, f"grid_id int, params string, {metric} double")


def kfold_metrics(df: DataFrame, key: str, label: str, pipeline: Pipeline, folds: int = 5, repeats: int = 1) -> DataFrame:
    """M6: repeated k-fold; per (repeat, fold) RMSE/MAE/R2 rows (F28 summarises them)."""
    rows = []
    for rep in range(repeats):
        d = fold_assignment(labelled(df, label), key, folds, seed=f"{42 + rep}")
        for f in range(folds):
            tr, va = d.filter(F.col("fold") != f), d.filter(F.col("fold") == f)
            p = fit_trees(pipeline, tr).transform(va)
            ev = RegressionEvaluator(labelCol=label)
            rows.append((rep, f, ev.evaluate(p, {ev.metricName: "rmse"}), ev.evaluate(p, {ev.metricName: "mae"}),
                         ev.evaluate(p, {ev.metricName: "r2"})))
    return df.sparkSession.createDataFrame(rows, "repeat int, fold int, rmse double, mae double, r2 double")


def learning_curve(df: DataFrame, key: str, label: str, pipeline: Pipeline, sizes=(0.2, 0.36, 0.52, 0.68, 0.84, 1.0),
                   folds: int = 5, parallelism: int = 4) -> DataFrame:
    """M7: train / validation RMSE per training share (nested hash thresholds); ``parallelism`` fits run at a time."""
    d = fold_assignment(df, key, folds)
    h = F.conv(F.substring(F.md5(F.concat(F.lit("lc:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint") % 1000
    d = d.withColumn("__h", h).persist()  # read by every fit

    def fitted(size, fold):
        tr = d.filter((F.col("fold") != fold) & (F.col("__h") < int(size * 1000)))
        m = fit_trees(pipeline.copy(), tr)
        return rmse(m.transform(tr), label), rmse(m.transform(d.filter(F.col("fold") == fold)), label)

    try:
        with ThreadPool(parallelism) as pool:
            found = pool.starmap(inheritable_thread_target(df.sparkSession)(fitted), [(s, f) for s in sizes for f in range(folds)],
                                 chunksize=1)
    finally:
        d.unpersist()
    rows = []
    for i, s in enumerate(sizes):
        tr_r, va_r = zip(*found[i * folds:(i + 1) * folds])
        rows.append((float(s), sum(tr_r) / folds, sum(va_r) / folds))
    out = df.sparkSession.createDataFrame(rows, "train_share double, train_rmse double, valid_rmse double")
    return out.withColumn("gap", F.col("valid_rmse") - F.col("train_rmse"))


def _shifted(df: DataFrame, key: str, cols: dict[str, str], repeat: int, rows: int) -> DataFrame:
    """Each column of ``cols`` (name -> output) shifted cyclically within hash groups of about 4,096 of the ``rows`` rows,
    so no task holds more than a group whatever the table's size."""
    groups = max(1, rows // 4096)
    h = F.md5(F.concat(F.lit(f"perm{repeat}:"), F.col(key).cast("string")))
    d = df.withColumn("__b", F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") % groups).withColumn("__o", h)
    w = Window.partitionBy("__b").orderBy("__o")
    wa = Window.partitionBy("__b").orderBy("__o").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return d.withColumns({out: F.coalesce(F.lead(c).over(w), F.first(c).over(wa)) for c, out in cols.items()}).drop("__b", "__o")


def permute_column(df: DataFrame, key: str, col: str, repeat: int) -> DataFrame:
    """Permute ``col`` (see :func:`_shifted`)."""
    return _shifted(df, key, {col: col}, repeat, df.count())


def permutation_importance(model: PipelineModel, df: DataFrame, key: str, label: str, cols: list[str],
                           repeats: int = 5) -> DataFrame:
    """M8: mean and std increase of RMSE when one feature is permuted.

    A repeat shifts all columns in one window and measures them, and the model on the rows as they are, in one aggregate.
    """
    own, moved = {c: f"__o{i}" for i, c in enumerate(cols)}, {c: f"__p{i}" for i, c in enumerate(cols)}
    rest = [c for c in df.columns if c not in cols]
    d = df.persist()  # read by every repeat

    def squares(frame, out):
        scored = model.transform(frame)
        return scored.withColumn(out, F.pow(F.col("prediction") - F.col(label).cast("double"), 2)).drop(
            *[c for c in scored.columns if c not in frame.columns])

    try:
        n = d.count()
        deltas = {c: [] for c in cols}
        for r in range(repeats):
            p = _shifted(d, key, moved, r, n).select(*rest, *cols, *[F.col(c).alias(own[c]) for c in cols], *moved.values())
            errors = ["__e"]
            p = squares(p, "__e")
            for i, c in enumerate(cols):
                p = p.select(*rest, *[F.col(moved[x] if x == c else own[x]).alias(x) for x in cols], *own.values(), *moved.values(), *errors)
                errors.append(f"__e{i}")
                p = squares(p, errors[-1])
            mse = p.agg(*[F.avg(e).alias(e) for e in errors]).first()
            for i, c in enumerate(cols):
                deltas[c].append(mse[f"__e{i}"] ** 0.5 - mse["__e"] ** 0.5)
    finally:
        d.unpersist()
    rows = []
    for c in cols:
        m = sum(deltas[c]) / repeats
        sd = (sum((x - m) ** 2 for x in deltas[c]) / repeats) ** 0.5
        rows.append((c, m, sd))
    return df.sparkSession.createDataFrame(rows, "feature string, importance_mean double, importance_std double")


def select_feature_subset(importance: DataFrame, top: int = 16) -> list[str]:
    """M9's candidates: features with positive importance, the best ``top`` (see :func:`refit_on_subset`)."""
    r = importance.filter(F.col("importance_mean") > 0).orderBy(F.col("importance_mean").desc(), "feature").limit(top)
    return [x["feature"] for x in r.collect()]


def refit_on_subset(build, model: PipelineModel, train: DataFrame, test: DataFrame, label: str, cols: list[str],
                    importance: DataFrame, top: int = 16, least: int = 8) -> dict:
    """M9: fit ``build(features)`` again on the best features and keep that model if its RMSE on ``test`` is not worse.

    Tables of at most ``least`` columns, and those without a feature of positive importance, keep ``model``.  Returns ``model``,
    ``features``, ``kept_subset``, ``rmse_all`` and ``rmse_subset`` (None without a candidate).
    """
    error = lambda m: rmse(predict(m, test, "__p").withColumn("prediction", F.col("__p")), label)
    out = {"model": model, "features": list(cols), "kept_subset": False, "rmse_all": error(model), "rmse_subset": None}
    chosen = select_feature_subset(importance, min(top, len(cols))) if len(cols) > least else []
    if chosen:
        smaller = fit_trees(build(chosen), train)
        out["rmse_subset"] = error(smaller)
        if out["rmse_subset"] <= out["rmse_all"]:
            out.update(model=smaller, features=chosen, kept_subset=True)
    return out


SEGMENT_NAMES = ["Fast Learner", "Low Engagement", "Struggling Learner"]  # fixed values, by engagement desc


def kmeans_segments(df: DataFrame, cols: list[str], k: int = 3, seed: int = 42, order_col: int = 0):
    """K-means on ``cols`` (NULL -> 0); clusters named by centre of the first
    column descending.  Returns (model, names DataFrame(cluster, cluster_label))."""
    d = df.select("*", *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"__k_{c}") for c in cols])
    pipe = Pipeline(stages=[assembler([f"__k_{c}" for c in cols], "kfeatures"),
                            KMeans(k=k, seed=seed, featuresCol="kfeatures", predictionCol="cluster")])
    model = pipe.fit(d)
    centres = model.stages[-1].clusterCenters()
    order = sorted(range(len(centres)), key=lambda i: (-float(centres[i][order_col]), i))
    names = [(int(i), SEGMENT_NAMES[j] if j < len(SEGMENT_NAMES) else f"Segment {j}") for j, i in enumerate(order)]
    return model, df.sparkSession.createDataFrame(names, "cluster int, cluster_label string")


def enrich(df: DataFrame, km_model: PipelineModel, names: DataFrame, cols: list[str],
           score_model: PipelineModel | None = None) -> DataFrame:
    """Add cluster label and predicted score (clip 0..100) to every row."""
    d = df.select("*", *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"__k_{c}") for c in cols])
    d = km_model.transform(d).drop("kfeatures", *[f"__k_{c}" for c in cols])
    d = d.join(F.broadcast(names), "cluster", "left")
    if score_model is not None:
        d = predict(score_model, d, "predicted_score")
    return d


def implicit_factors(interactions: DataFrame, user: str, item: str, weight: str, rank: int = 32,
                     iters: int = 10, reg: float = 0.02, seed: int = 42):
    """Implicit-feedback matrix factorisation (ALS); weights floored at 0.05.

    User and item ids of any type are numbered densely through dictionaries of distinct values.
    Returns (user factors, item factors) with ``vector`` arrays.
    """
    def dense(col, name):
        """A dense id per distinct value: running number within hash buckets plus the buckets' offsets."""
        value = f"__{name}"
        d = interactions.select(F.col(col).alias(value)).filter(F.col(value).isNotNull()).distinct()
        d = d.withColumn("__b", F.pmod(F.xxhash64(value), F.lit(256)).cast("int"))
        before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = d.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).select(
            "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))  # 256 rows
        number = F.row_number().over(Window.partitionBy("__b").orderBy(value)) - 1
        return d.withColumn("__k", number).join(offsets, "__b").select(value, (F.col("__k") + F.col("__off")).cast("int").alias(f"__{name}id"))

    users, idx = dense(user, "u"), dense(item, "i")
    d = (interactions.join(idx, F.col(item) == F.col("__i")).join(users, F.col(user) == F.col("__u"))
         .groupBy(F.col("__uid"), F.col("__iid"))
         .agg(F.sum(F.greatest(F.col(weight), F.lit(0.05))).alias("__w")))
    als = ALS(userCol="__uid", itemCol="__iid", ratingCol="__w", implicitPrefs=True, rank=rank,
              maxIter=iters, regParam=reg, seed=seed, coldStartStrategy="drop", nonnegative=False)
    m = als.fit(d)
    uf = m.userFactors.join(users, F.col("id") == F.col("__uid")).select(F.col("__u").alias(user), F.col("features").alias("vector"))
    itf = m.itemFactors.join(idx, F.col("id") == F.col("__iid")).select(F.col("__i").alias(item), F.col("features").alias("vector"))
    return uf, itf


def content_vectors(docs: DataFrame, key: str, text: str, k: int = 32, width: int = 1024) -> DataFrame:
    """TF-IDF over 1- and 2-grams (English stop words removed) reduced to <= k
    dims with PCA.  Every term counts: terms are hashed into ``width`` features, so no vocabulary is cut or
    held on the driver (PCA keeps a ``width`` x ``width`` matrix there)."""
    tok = RegexTokenizer(inputCol=text, outputCol="__tok", pattern="\\W+", minTokenLength=1)
    sw = StopWordsRemover(inputCol="__tok", outputCol="__uni")
    ng = NGram(n=2, inputCol="__uni", outputCol="__bi")
    pre = Pipeline(stages=[tok, sw, ng]).fit(docs)
    t = pre.transform(docs.select(key, text)).withColumn("__terms", F.concat("__uni", "__bi"))
    # the terms are counted once: the fits below and the result read the counts
    path = scratch_path(docs.sparkSession, f"content/{uuid.uuid4().hex}")
    HashingTF(inputCol="__terms", outputCol="__tf", numFeatures=width).transform(t).select(key, "__tf").write.parquet(path)
    counts = docs.sparkSession.read.parquet(path)
    v = IDF(inputCol="__tf", outputCol="__tfidf").fit(counts).transform(counts)
    pca = PCA(k=max(1, min(k, width)), inputCol="__tfidf", outputCol="__pca").fit(v)
    from pyspark.ml.functions import vector_to_array
    return pca.transform(v).select(key, vector_to_array("__pca").alias("vector"))
