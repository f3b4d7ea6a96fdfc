"""Model pipelines on MLlib: fit, reduce, select, cluster, measure.

Fits run on the cluster; a report DataFrame holds one row per metric.  Forests,
k-means and splits are seeded with 42.  The kernel SVM is re-aimed as a linear
one and hierarchical clustering as bisecting k-means.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.plans.storage import stored

SEED = 42


def feature_columns(df: DataFrame, leave: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in leave]


def _prepared(columns: Sequence[str], fill: str = "median", scale: bool = True) -> list:
    """Stages from numeric columns to the vector ``features``."""
    filled = [f"_f_{c}" for c in columns]
    stages = [Imputer(inputCols=list(columns), outputCols=filled, strategy=fill), VectorAssembler(inputCols=filled, outputCol="_raw")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    return stages


def _doubles(df: DataFrame, columns: Sequence[str]) -> list:
    return [F.col(c).cast("double").alias(c) for c in columns]


def _estimator(task: str, model: str, n_classes: int):
    forest = {"featuresCol": "features", "labelCol": "_y", "seed": SEED, "numTrees": 100}
    if task == "classification":
        if model == "random_forest":
            return RandomForestClassifier(**forest)
        if model == "logistic":
            return LogisticRegression(featuresCol="features", labelCol="_y", maxIter=100)
        if model == "svm":
            svc = LinearSVC(featuresCol="features", labelCol="_y", maxIter=50)
            return svc if n_classes <= 2 else OneVsRest(classifier=svc, featuresCol="features", labelCol="_y")
    elif task == "regression":
        if model == "random_forest":
            return RandomForestRegressor(**forest)
        if model == "linear":
            return LinearRegression(featuresCol="features", labelCol="_y")
    raise ValueError(f"no model {model} for task {task}")


def ml_pipeline(df: DataFrame, target: str, task: str = "classification", model: str = "random_forest", test_size: float = 0.2, cv: int = 5) -> DataFrame:
    """Split, fill, scale, fit and measure; rows (kind, name, value).

    Medians and scales are learnt on the training part only.  ``cv`` folds are
    scored on the training part; importances list the ten best features.
    """
    features = feature_columns(df, [target])
    if not features:
        raise ValueError("no numeric feature column")
    rows = df.where(F.col(target).isNotNull()).select(target, *_doubles(df, features))
    stages = _prepared(features)
    n_classes = 0
    if task == "classification":
        indexer = StringIndexer(inputCol="_t", outputCol="_y", stringOrderType="alphabetAsc").fit(rows.select(F.col(target).cast("string").alias("_t")))
        rows = indexer.transform(rows.withColumn("_t", F.col(target).cast("string"))).drop("_t")
        n_classes = len(indexer.labels)
        main = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy")
        measures = {m: MulticlassClassificationEvaluator(labelCol="_y", metricName=k) for m, k in (("accuracy", "accuracy"), ("f1", "f1"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"))}
    else:
        rows = rows.withColumn("_y", F.col(target).cast("double"))
        main = RegressionEvaluator(labelCol="_y", metricName="r2")
        measures = {m: RegressionEvaluator(labelCol="_y", metricName=m) for m in ("r2", "rmse", "mae")}
    # written once, so that every pass of the fit and the measures sees the same split
    rows = stored(rows.withColumn("_u", F.rand(SEED)), "split")
    train, test = rows.where(F.col("_u") >= test_size).drop("_u"), rows.where(F.col("_u") < test_size).drop("_u")
    pipe = Pipeline(stages=[*stages, _estimator(task, model, n_classes)])
    out: list[tuple[str, str, float]] = []
    if cv and cv > 1:
        tuned = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=main, numFolds=cv, seed=SEED, parallelism=2).fit(train)
        fitted = tuned.bestModel
        out.append(("cv", f"mean_{main.getMetricName()}", float(tuned.avgMetrics[0])))
    else:
        fitted = pipe.fit(train)
    scored = fitted.transform(test)
    out += [("metric", name, float(e.evaluate(scored))) for name, e in measures.items()]
    last = fitted.stages[-1]
    weights = None
    if hasattr(last, "featureImportances"):
        weights = last.featureImportances.toArray()
    elif task == "regression":
        weights = abs(last.coefficients.toArray())
    elif model == "logistic":
        weights = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    if weights is not None:
        best = sorted(zip(features, (float(w) for w in weights)), key=lambda p: (-p[1], p[0]))[:10]
        out += [("importance", name, w) for name, w in best]
    return df.sparkSession.createDataFrame(out, "kind string, name string, value double")


def standardise(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """z scores by the sample deviation; columns without variance are dropped.

    One aggregate row holds all means and deviations.
    """
    columns = list(columns or feature_columns(df))
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).first()
    live = [c for c in columns if stats[f"s_{c}"]]
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *[((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).alias(c) for c in live])


def ml_reduce(df: DataFrame, columns: Sequence[str] | None = None, k: int = 2) -> DataFrame:
    """Principal components of filled (0) and standardised columns: explained and cumulative share."""
    columns = list(columns or feature_columns(df))
    filled = df.select(*_doubles(df, columns)).na.fill(0.0)
    staged = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)])
    scaled = staged.fit(filled).transform(filled)
    model = PCA(k=min(k, len(columns)), inputCol="features", outputCol="_pc").fit(scaled)
    shares = [float(v) for v in model.explainedVariance]
    rows = [(i + 1, s, float(sum(shares[: i + 1]))) for i, s in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")


def project(df: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """Component scores per row, columns pc1..pck."""
    filled = df.na.fill(0.0, subset=list(columns))
    stages = [VectorAssembler(inputCols=list(columns), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True), PCA(k=k, inputCol="_z", outputCol="_pc")]
    from pyspark.ml.functions import vector_to_array

    scored = Pipeline(stages=stages).fit(filled).transform(filled).withColumn("_a", vector_to_array("_pc"))
    return scored.select(*[c for c in df.columns if c not in columns], *[F.get("_a", F.lit(i)).alias(f"pc{i + 1}") for i in range(k)])


def components_for(explained: DataFrame, share: float = 0.8, most: int = 50) -> DataFrame:
    """Fewest components reaching the share, at most ``most`` (or all there are)."""
    reach = F.min(F.when(F.col("cumulative") >= share, F.col("component")))
    return explained.agg(F.least(F.coalesce(reach, F.max("component")), F.lit(most)).alias("n_components"))


def ml_feature(df: DataFrame, target: str, task: str = "classification", top: int = 10) -> DataFrame:
    """Forest importance of the best features and their strongest correlation among them."""
    features = feature_columns(df, [target])
    rows = df.where(F.col(target).isNotNull()).select(F.col(target).alias("_t"), *_doubles(df, features)).na.fill(0.0)
    if task == "classification":
        rows = StringIndexer(inputCol="_t", outputCol="_y", stringOrderType="alphabetAsc").fit(rows.withColumn("_t", F.col("_t").cast("string"))).transform(rows.withColumn("_t", F.col("_t").cast("string")))
        forest = RandomForestClassifier(featuresCol="features", labelCol="_y", seed=SEED, numTrees=100)
    else:
        rows = rows.withColumn("_y", F.col("_t").cast("double"))
        forest = RandomForestRegressor(featuresCol="features", labelCol="_y", seed=SEED, numTrees=100)
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    weights = [float(w) for w in forest.fit(vectors).featureImportances.toArray()]
    best = sorted(zip(features, weights), key=lambda p: (-p[1], p[0]))[:top]
    names = [n for n, _ in best]
    matrix = Correlation.corr(VectorAssembler(inputCols=names, outputCol="_c").transform(rows.select(*names)), "_c").first()[0].toArray()
    out = []
    for i, (name, w) in enumerate(best):
        others = [(abs(matrix[i][j]), names[j]) for j in range(len(names)) if j != i]
        r, mate = max(others) if others else (0.0, None)
        out.append((i + 1, name, w, mate, float(r)))
    return df.sparkSession.createDataFrame(out, "rank int, feature string, importance double, closest string, abs_r double")


def ml_cluster(df: DataFrame, columns: Sequence[str], k: int = 3, method: str = "kmeans") -> DataFrame:
    """Clusters of standardised columns: size, means of the first five columns, silhouette."""
    columns = list(columns)
    filled = df.select(*_doubles(df, columns)).na.fill(0.0)
    # bisecting starts its halves around the centre, which must not be zero
    centred = method != "hierarchical"
    prepared = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=centred, withStd=True)]).fit(filled).transform(filled)
    if method == "kmeans":
        model = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster")
    elif method == "hierarchical":
        model = BisectingKMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster")
    else:
        raise ValueError("method must be kmeans or hierarchical")
    found = model.fit(prepared).transform(prepared)
    several = len(found.select("cluster").distinct().limit(2).collect()) > 1
    score = float(ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(found)) if several else None
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns[:5]]).withColumn("silhouette", F.lit(score).cast("double"))


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    e = F.col(truth) - F.col(predicted)
    s = df.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("_mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(truth).alias("_v"))
    return s.select("n", F.sqrt("_mse").alias("rmse"), "mae", (1 - F.col("_mse") / F.nullif("_v", F.lit(0.0))).alias("r2"))
