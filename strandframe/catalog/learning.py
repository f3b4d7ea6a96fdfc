"""Registered queries on model pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog.base import query
from strandframe.operators import learning as L

_DIMS = [f"e{i}" for i in range(64)]


def _vectors(x):
    return x.table("embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(_DIMS)])


@query("ml_logistic")
def _(x):
    return L.ml_pipeline(_vectors(x).drop("vec_id"), "label", "classification", "logistic", cv=0)


@query("ml_forest")
def _(x):
    return L.ml_pipeline(_vectors(x).drop("vec_id"), "label", "classification", "random_forest", cv=0)


@query("ml_linear_svm")
def _(x):
    return L.ml_pipeline(x.table("orders").select("o_totalprice", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("done")), "done", "classification", "svm", cv=0)


@query("ml_linear")
def _(x):
    return L.ml_pipeline(x.table("lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax"), "l_extendedprice", "regression", "linear", cv=3)


@query("ml_pca")
def _(x):
    return L.ml_reduce(_vectors(x), _DIMS, 60)


@query("pca_scores")
def _(x):
    return L.project(_vectors(x), _DIMS, 2)


@query("pca_component_count")
def _(x):
    return L.components_for(L.ml_reduce(_vectors(x), _DIMS, 60))


@query("ml_feature")
def _(x):
    return L.ml_feature(_vectors(x).drop("vec_id"), "label")


@query("ml_kmeans")
def _(x):
    return L.ml_cluster(_vectors(x), _DIMS, 10)


@query("ml_bisecting")
def _(x):
    return L.ml_cluster(_vectors(x), _DIMS, 8, "hierarchical")


@query("standardise", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS l_quantity, round((l_tax - avg(l_tax) OVER ()) / stddev_samp(l_tax) OVER (), 6) AS l_tax FROM lineitem")
def _(x):
    t = x.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.lit(1.0).alias("constant"))
    z = L.standardise(t, ["l_quantity", "l_tax", "constant"])
    return z.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"))


@query("classification_metrics", "SELECT count(*) AS n, round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels")
def _(x):
    return L.classification_metrics(x.table("labels"), "quality", "toxic").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "regression_metrics",
    """WITH p AS (SELECT l_extendedprice AS t, l_quantity * 1500 AS y FROM lineitem) SELECT count(*) AS n, round(sqrt(avg((t - y) * (t - y))), 4) AS rmse, round(avg(abs(t - y)), 4) AS mae, round(1 - avg((t - y) * (t - y)) / var_pop(t), 6) AS r2 FROM p""",
)
def _(x):
    r = L.regression_metrics(x.table("lineitem").withColumn("y", F.col("l_quantity") * 1500), "l_extendedprice", "y")
    return r.select("n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))
