"""Components, clusters, classifiers: results that no SQL gives; tests check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml
from . import query

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _ratio_sql() -> str:
    """Share of the first of two components from the closed form of a 2 x 2 covariance."""
    return "WITH c AS (SELECT covar_samp(l_discount, l_discount) AS a, covar_samp(l_tax, l_tax) AS b, covar_samp(l_discount, l_tax) AS c FROM lineitem), e AS (SELECT (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c) AS x, a + b AS s FROM c) SELECT round(x / s, 6) AS first, round(1 - x / s, 6) AS second FROM e"


@query(_ratio_sql())
def pca_ratio(t):
    pca = ml.fit_components(t.lineitem, ["l_discount", "l_tax"])
    return t.lineitem.sparkSession.createDataFrame([(float(pca.ratios[0]), float(pca.ratios[1]))], "first double, second double").select(F.round("first", 6).alias("first"), F.round("second", 6).alias("second"))


@query()
def pca_transform(t):
    return ml.transform_components(t.lineitem, ml.fit_components(t.lineitem, MEASURES, 2), ["l_orderkey"])


def _embedding_size(t) -> int:
    return t.embeddings.agg(F.max(F.size("embedding"))).first()[0]


@query()
def pca_needed_dims(t):
    rows = t.embeddings.select(*[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(_embedding_size(t))])
    pca = ml.fit_components(rows, rows.columns)
    n, names = ml.needed_dimensions(pca, 0.9)
    return t.embeddings.sparkSession.createDataFrame([(n, len(names), f, p) for f, p in ml.feature_powers(pca)], "components int, features int, feature string, share double")


@query()
def kmeans_silhouette(t):
    return ml.optimal_k(t.embeddings, "embedding", "vec_id", [2, 3, 4])


@query()
def kmeans_elbow(t):
    return ml.elbow(t.embeddings, "embedding", [1, 2, 4])


@query()
def classify_cv(t):
    rows = t.labels.join(t.documents, "doc_id").select("doc_id", "quality", (F.col("n_chars") / 1000).alias("size"), F.length(F.regexp_replace("text", "[A-Za-z ]", "")).cast("double").alias("marks"))
    return ml.classify(rows, ["size", "marks"], "quality", "doc_id", k=3)["report"]


@query()
def smote(t):
    rows = t.labels.join(t.documents, "doc_id").select("doc_id", "quality", F.col("n_chars").cast("double").alias("size"), F.length("source").cast("double").alias("s"))
    return ml.smote(rows, ["size", "s"], "quality", "doc_id")


@query()
def tsne(t):
    names = [f"e{i}" for i in range(_embedding_size(t))]
    rows = t.embeddings.select("vec_id", "label", *[F.element_at("embedding", i + 1).alias(n) for i, n in enumerate(names)])
    return ml.tsne(rows, names, "vec_id", 15.0, keep=["label"])
