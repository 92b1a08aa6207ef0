"""Principal components, clustering, classification."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import quoted
from .evaluation import confusion, mean_report, report
from .ranges import number_within

#: t-SNE is computed on the driver over at most so many rows.
TSNE_ROWS = 10_000


# --- principal components ----------------------------------------------------------------------------------------------


@dataclass
class Components:
    """Weights (components x features, rows of length 1, each row's largest weight positive), eigenvalues of all
    components, and the means that were taken off."""

    features: list[str]
    weights: np.ndarray
    eigenvalues: np.ndarray
    means: np.ndarray

    @property
    def loadings(self) -> np.ndarray:
        return self.weights**2

    @property
    def ratios(self) -> np.ndarray:
        return self.eigenvalues / self.eigenvalues.sum()

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(f, float(self.means[j]), float(self.eigenvalues[j]) if j < len(self.eigenvalues) else None, self.weights[:, j].tolist()) for j, f in enumerate(self.features)]
        spark.createDataFrame(rows, "feature string, mean double, eigenvalue double, weights array<double>").coalesce(1).write.mode("errorifexists").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Components:
        rows = spark.read.parquet(path).collect()  # a row a feature
        return cls([r["feature"] for r in rows], np.array([r["weights"] for r in rows]).T, np.array([r["eigenvalue"] for r in rows if r["eigenvalue"] is not None]), np.array([r["mean"] for r in rows]))


def likely_dimension(eigenvalues: np.ndarray, n: int) -> int:
    """Minka's criterion: the number of components of greatest evidence."""
    d = len(eigenvalues)
    best, chosen = -math.inf, 1
    for k in range(1, d):
        rest = eigenvalues[k:].mean()
        if rest <= 1e-15 or eigenvalues[k - 1] <= 1e-15:
            break
        prior = -k * math.log(2) + sum(math.lgamma((d - i) / 2) - math.log(math.pi) * (d - i) / 2 for i in range(k))
        m = d * k - k * (k + 1) / 2
        shape = np.concatenate([eigenvalues[:k], np.full(d - k, rest)])
        spread = sum(math.log((eigenvalues[i] - eigenvalues[j]) * (1 / shape[j] - 1 / shape[i])) + math.log(n) for i in range(k) for j in range(i + 1, d) if eigenvalues[i] > eigenvalues[j])
        value = prior - np.log(eigenvalues[:k]).sum() * n / 2 - n * (d - k) / 2 * math.log(rest) + math.log(2 * math.pi) * (m + k) / 2 - spread / 2 - k / 2 * math.log(n)
        if value > best:
            best, chosen = value, k
    return chosen


def fit_components(df: DataFrame, features: Sequence[str], n_components: int | float | str | None = None) -> Components:
    """From the covariance matrix, whose cells are aggregates of one pass: features x features numbers reach the driver.

    n_components: a number; a share of the variance to be reached; 'mle'; None for all."""
    d = len(features)
    means = df.agg(F.count("*").alias("n"), *[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    n, centre = means["n"], np.array([means[f"m{i}"] for i in range(d)], float)
    off = [quoted(f) - float(centre[i]) for i, f in enumerate(features)]
    cells = df.agg(*[F.sum(off[i] * off[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = cells[f"c{i}_{j}"] / max(1, n - 1)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    vectors = vectors * np.sign(vectors[np.arange(d), np.abs(vectors).argmax(axis=1)])[:, None]
    most = min(n, d)
    if n_components is None:
        k = most
    elif n_components == "mle":
        k = likely_dimension(values, n)
    elif isinstance(n_components, float):
        k = int(np.searchsorted(np.cumsum(values / values.sum()), n_components) + 1)
    else:
        k = int(n_components)
    return Components(list(features), vectors[: min(k, most)], values[:most], centre)


def transform_components(df: DataFrame, pca: Components, keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns and comp0, comp1, ...: centred rows on the weights, as plain expressions."""
    term = lambda row: sum(((quoted(f) - float(m)) * float(w) for f, m, w in zip(pca.features, pca.means, row)), F.lit(0.0))
    return df.select(*map(quoted, keep), *[term(row).alias(f"comp{i}") for i, row in enumerate(pca.weights)])


def feature_powers(pca: Components) -> list[tuple[str, float]]:
    """(feature, share): a feature's loadings times the eigenvalues, as shares, largest first."""
    power = (pca.loadings * pca.eigenvalues[: len(pca.weights), None]).sum(axis=0)
    return sorted(zip(pca.features, (power / power.sum()).tolist()), key=lambda x: (-x[1], x[0]))


def needed_dimensions(pca: Components, threshold: float) -> tuple[int, list[str]]:
    """How many components, and which features, reach a share of the variance; above 1 it is in percent."""
    share = threshold / 100 if threshold > 1 else threshold
    reached = int(np.searchsorted(np.cumsum(pca.ratios), share - 1e-12) + 1)
    total, names = 0.0, []
    for name, part in feature_powers(pca):
        if total >= share - 1e-12:
            break
        names.append(name)
        total += part
    return min(reached, len(pca.ratios)), names


def top_features(pca: Components) -> list[tuple[int, str, float]]:
    """(component, feature, weight) of each component's greatest weight."""
    return [(i, pca.features[int(row.argmax())], float(row.max())) for i, row in enumerate(pca.weights)]


# --- clusters ----------------------------------------------------------------------------------------------------------


def _vectors(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    if isinstance(features, str):
        return df.withColumn("__features", array_to_vector(F.transform(quoted(features), lambda x: x.cast("double"))))
    return VectorAssembler(inputCols=list(features), outputCol="__features").transform(df)


def cluster(df: DataFrame, features: Sequence[str] | str, k: int, seed: int = 1066):
    """(rows with ``cluster``, model)."""
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster").fit(_vectors(df, features))
    return model.transform(_vectors(df, features)).drop("__features"), model


def populations(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").count()


def silhouette(clustered: DataFrame, features: Sequence[str] | str, key: str, block: int = 8192) -> float | None:
    """Mean Euclidean silhouette over all rows: blocks of about ``block`` rows are compared with each other, a pair a
    task's. The work grows with the square of the rows."""
    v = quoted(features) if isinstance(features, str) else F.array(*[quoted(f).cast("double") for f in features])
    # rows equal in all count as often as they occur
    rows = clustered.select(quoted(key).alias("i"), v.alias("v"), F.col("cluster").cast("int").alias("c")).groupBy("i", "v", "c").agg(F.count("*").alias("m"))
    sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.sum("m").alias("n")).collect()}  # a row a cluster
    labels = sorted(sizes)
    if len(labels) < 2:
        return None
    total = sum(sizes.values())
    across = -(-total // block)
    to = F.pmod(F.xxhash64("i", "v"), F.lit(across))
    everywhere = F.explode(F.expr(f"sequence(0L, {across - 1}L)"))
    left = rows.select("i", "v", "c", "m", to.alias("lb"), everywhere.alias("rb"))
    # names of its own, as the two sides come from one table
    right = rows.select(F.col("v").alias("x"), F.col("c").alias("xc"), F.col("m").alias("xm"), to.alias("xr"), everywhere.alias("xl"))
    kinds = dict(rows.dtypes)

    def compare(asked, known):
        import pandas as pd

        if not len(asked) or not len(known):
            return pd.DataFrame({n: [] for n in ("i", "v", "c", "m", "s")})
        y = np.array(known["x"].tolist(), float)
        mean = y.mean(axis=0)
        y -= mean
        weight = (known["xc"].to_numpy()[:, None] == np.array(labels)) * known["xm"].to_numpy()[:, None].astype(float)
        x, sums = np.array(asked["v"].tolist(), float) - mean, []
        for k in range(0, len(x), 512):
            part = x[k : k + 512]
            far = (part**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * part @ y.T
            sums += (np.sqrt(np.maximum(far, 0)) @ weight).tolist()
        return asked[["i", "v", "c", "m"]].assign(s=sums)

    met = left.groupBy("lb", "rb").cogroup(right.groupBy("xl", "xr")).applyInPandas(compare, f"i {kinds['i']}, v {kinds['v']}, c int, m long, s array<double>")
    whole = met.groupBy("i", "v", "c", "m").agg(F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(len(labels))]).alias("s"))
    own = F.array_position(F.array(*map(F.lit, labels)), F.col("c")).cast("int") - 1
    count = F.array(*[F.lit(float(sizes[c])) for c in labels])
    whole = whole.select("m", "s", own.alias("own"), count.alias("n"))
    others = F.array_min(F.transform("s", lambda t, j: F.when(j != F.col("own"), t / F.get(F.col("n"), j))))
    rest = F.get("n", F.col("own")) - 1
    whole = whole.select("m", rest.alias("rest"), (F.get("s", F.col("own")) / F.greatest(rest, F.lit(1.0))).alias("a"), others.alias("b"))
    one = F.when(F.col("rest") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300))).otherwise(0.0)
    return float(whole.agg(F.sum(one * F.col("m")) / total).first()[0])


def optimal_k(df: DataFrame, features: Sequence[str] | str, key: str, ks: Sequence[int], seed: int = 1066) -> DataFrame:
    """(k, silhouette, cost) of each number of clusters that is possible."""
    n = df.count()
    rows = []
    for k in ks:
        if 2 <= k <= n - 1:
            made, model = cluster(df, features, k, seed)
            rows.append((k, silhouette(made, features, key), float(model.summary.trainingCost)))
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, cost double")


def elbow(df: DataFrame, features: Sequence[str] | str, ks: Sequence[int] = range(1, 11), seed: int = 1066) -> DataFrame:
    """(k, cost); a single cluster's cost is the spread about the mean."""
    made = _vectors(df, features)
    total = made.select(Summarizer.metrics("variance", "count").summary(F.col("__features")).alias("s")).select("s.variance", "s.count").first()
    rows = [(k, float(total["variance"].toArray().sum() * (total["count"] - 1) if k == 1 else KMeans(k=k, seed=seed, featuresCol="__features").fit(made).summary.trainingCost)) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, cost double")


def _affinities(distances: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric neighbour probabilities, each row's width found by bisection."""
    n = len(distances)
    p, goal = np.zeros((n, n)), math.log(perplexity)
    for i in range(n):
        d, low, high, beta = np.delete(distances[i], i), 0.0, math.inf, 1.0
        for _ in range(60):
            w = np.exp(-(d - d.min()) * beta)
            entropy = math.log(w.sum()) + beta * float(((d - d.min()) * w).sum()) / w.sum()
            if abs(entropy - goal) < 1e-5:
                break
            low, high = (beta, high) if entropy > goal else (low, beta)
            beta = beta * 2 if high == math.inf else (low + high) / 2
        p[i, np.arange(n) != i] = w / w.sum()
    return np.maximum((p + p.T) / (2 * n), 1e-12)


def tsne(df: DataFrame, features: Sequence[str], key: str, perplexity: float | None = None, rows: int = 1000, iterations: int = 300, seed: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """(key, tsne_x, tsne_y, kept columns): the published algorithm (cosine distances, principal components as start) over the
    first ``rows`` rows by key, on the driver. The perplexity is below the number of rows."""
    if perplexity is not None and not isinstance(perplexity, float):
        raise TypeError("the perplexity is a float")
    if rows > TSNE_ROWS:
        raise ValueError(f"at most {TSNE_ROWS} rows")
    some = df.orderBy(quoted(key)).limit(rows)
    data = some.select(quoted(key), *map(quoted, keep), F.array(*[quoted(f).cast("double") for f in features]).alias("__v")).collect()
    x = np.nan_to_num(np.array([r["__v"] for r in data], float))
    n = len(x)
    if n < 3:
        raise ValueError("too few rows")
    perplexity = min(30.0, n - 1.0) if perplexity is None else min(perplexity, n - 1.0)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    p = _affinities(np.maximum(1 - unit @ unit.T, 0), perplexity)
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    y = np.zeros((n, 2))
    y[:, : min(2, u.shape[1])] = (u * s)[:, :2]
    y = y / max(y[:, 0].std(), 1e-300) * 1e-4 + np.random.default_rng(seed).normal(0, 1e-6, (n, 2))
    speed, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 50)
    for step in range(iterations):
        close = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2))
        np.fill_diagonal(close, 0)
        pull = (p * (12 if step < 100 else 1) - np.maximum(close / close.sum(), 1e-12)) * close
        grad = 4 * (np.diag(pull.sum(axis=1)) - pull) @ y
        gain = np.maximum(np.where(np.sign(grad) != np.sign(speed), gain + 0.2, gain * 0.8), 0.01)
        speed = (0.5 if step < 100 else 0.8) * speed - rate * gain * grad
        y = y + speed
        y -= y.mean(axis=0)
    schema = some.select(quoted(key), *map(quoted, keep)).schema.add("tsne_x", "double").add("tsne_y", "double")
    return df.sparkSession.createDataFrame([(*r[:-1], float(a), float(b)) for r, (a, b) in zip(data, y)], schema)


@dataclass
class ClusterSearch:
    """Silhouettes by perplexity and number of clusters, and the best clustering."""

    silhouettes: DataFrame
    perplexity: float
    k: int
    best: float
    clustered: DataFrame
    extra: dict = field(default_factory=dict)

    def to_json(self) -> str:
        import json

        return json.dumps({"perplexity": self.perplexity, "n_clusters": self.k, "silhouette": self.best, "table": [r.asDict() for r in self.silhouettes.collect()], **self.extra}, sort_keys=True)


def read_search(spark: SparkSession, text: str) -> ClusterSearch:
    """A search back from ``to_json``; its clustered rows aren't in there."""
    import json

    found = json.loads(text)
    table = [(r["perplexity"], r["n_clusters"], r["silhouette"]) for r in found.pop("table")]
    kept = [found.pop(n) for n in ("perplexity", "n_clusters", "silhouette")]
    schema = "perplexity double, n_clusters int, silhouette double"
    return ClusterSearch(spark.createDataFrame(table, schema), *kept, spark.createDataFrame([], "cluster int"), found)


def search_clusters(df: DataFrame, features: Sequence[str], key: str, perplexities: Sequence[float], ks: Sequence[int], rows: int = 500, keep: Sequence[str] = ()) -> ClusterSearch:
    """t-SNE at each perplexity below the number of rows, k-means at each k, best silhouette (the first of equals). Kept
    columns that aren't there are left out."""
    keep = [k for k in keep if k in df.columns]
    n = min(rows, df.count())
    table, top = [], None
    for p in perplexities:
        if p >= n:
            continue
        points = tsne(df, features, key, float(p), rows, keep=keep).cache()
        for k in ks:
            if 2 <= k <= n - 1:
                made, _ = cluster(points, ["tsne_x", "tsne_y"], k)
                s = silhouette(made, ["tsne_x", "tsne_y"], key)
                table.append((float(p), k, s))
                if s is not None and (top is None or s > top[2]):
                    top = (float(p), k, s, made)
    if top is None:
        raise ValueError("no perplexity and number of clusters fit the rows")
    return ClusterSearch(df.sparkSession.createDataFrame(table, "perplexity double, n_clusters int, silhouette double"), *top)


# --- classification ----------------------------------------------------------------------------------------------------


def folds(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """``fold`` by class, in runs of the key's order (stratified, not shuffled)."""
    placed = number_within(df, label, [key], "__place")
    sizes = df.groupBy(quoted(label).alias("__of")).agg(F.count("*").alias("__n"))
    whole = placed.join(sizes, quoted(label).eqNullSafe(F.col("__of")))
    return whole.withColumn("fold", F.floor(F.col("__place") * k / F.col("__n")).cast("int")).drop("__place", "__of", "__n")


def smote(df: DataFrame, features: Sequence[str], label: str, key: str, strategy: str = "auto", neighbours: int = 5, seed: int = 1066) -> DataFrame:
    """(label, features): df with synthetic rows, points between a row and one of its nearest in the class, until classes
    are as large as the largest. strategy: 'minority', 'not minority', 'not majority', 'all' or 'auto' (= not majority).

    Each block of at most 2000 rows of a class is compared with every block of it, a pair of blocks a task's, and a row's
    nearest of all are merged; of equally near rows the first by place counts."""
    sizes = {r[0]: r[1] for r in df.groupBy(quoted(label)).count().collect()}  # a row a class
    most, least = max(sizes.values()), min(sizes.values())
    wanted = {"minority": [c for c, n in sizes.items() if n == least], "not minority": [c for c, n in sizes.items() if n > least], "not majority": [c for c, n in sizes.items() if n < most], "all": [*sizes]}
    wanted["auto"] = wanted["not majority"]
    if strategy not in wanted:
        raise ValueError(f"strategies are {sorted(wanted)}")
    base = df.select(quoted(label), *[quoted(f).cast("double").alias(f) for f in features])
    grow = {c: most - sizes[c] for c in wanted[strategy] if most > sizes[c]}
    if not grow:
        return base
    spark = df.sparkSession
    plan = spark.createDataFrame([(c, sizes[c], n, max(1, -(-sizes[c] // 2000))) for c, n in grow.items()], f"`{label}` {dict(df.dtypes)[label]}, __n long, __new long, __blocks long")
    dealt = df.where(quoted(label).isNotNull()).withColumn("__dealt", F.xxhash64(quoted(key), F.lit(seed)))
    rows = number_within(dealt, label, ["__dealt", key, *features], "__place").join(F.broadcast(plan), label)  # a row a class
    rows = rows.withColumn("__block", F.pmod("__place", "__blocks")).withColumn("__make", (F.floor((F.col("__place") + 1) * F.col("__new") / F.col("__n")) - F.floor(F.col("__place") * F.col("__new") / F.col("__n"))).cast("long"))
    names = list(features)
    kind = dict(df.dtypes)[label]
    rows = rows.select(quoted(label).alias("__class"), "__place", "__block", "__blocks", "__make", F.array(*[quoted(f).cast("double") for f in names]).alias("__v"))
    every_block = F.explode(F.expr("sequence(0L, __blocks - 1L)"))
    # names of its own, as the two sides come from one table
    right = rows.select(F.col("__class").alias("__of"), F.col("__place").alias("__at"), F.col("__v").alias("__x"), F.col("__block").alias("__right"), every_block.alias("__left"))
    left = rows.where("__make > 0").select("__class", "__place", "__v", "__make", "__block", every_block.alias("__other"))

    def compare(asked, known):
        import pandas as pd

        out = []
        if len(asked) and len(known):
            known = known.sort_values("__at")
            x, places = np.array(known["__x"].tolist(), float), known["__at"].to_numpy()
            for c, place, count, v in zip(asked["__class"], asked["__place"], asked["__make"], asked["__v"]):
                d = ((x - np.array(v, float)) ** 2).sum(axis=1)
                d[places == place] = np.inf
                near = np.argsort(d, kind="stable")[:neighbours]
                near = near[places[near] != place]
                out.append((c, place, count, v, list(zip(d[near].tolist(), places[near].tolist(), x[near].tolist()))))
        return pd.DataFrame(out, columns=["__class", "__place", "__make", "__v", "__near"])

    found = "array<struct<d: double, place: long, v: array<double>>>"
    met = left.groupBy("__class", "__block", "__other").cogroup(right.groupBy("__of", "__left", "__right")).applyInPandas(compare, f"__class {kind}, __place long, __make long, __v array<double>, __near {found}")
    # a class is few blocks at a time: as many lists of ``neighbours`` as it has blocks
    merged = met.groupBy("__class", "__place").agg(F.first("__make").alias("__make"), F.first("__v").alias("__v"), F.slice(F.array_sort(F.flatten(F.collect_list("__near"))), 1, neighbours).alias("__near"))

    def make(batches):
        import pandas as pd

        for pdf in batches:
            made = []
            for c, place, count, v, near in zip(pdf["__class"], pdf["__place"], pdf["__make"], pdf["__v"], pdf["__near"]):
                rng, v = np.random.default_rng([seed, int(place)]), np.array(v, float)
                for _ in range(int(count)):
                    to = np.array(near[rng.integers(len(near))]["v"], float) if len(near) else v
                    made.append((c, *(v + rng.random() * (to - v))))
            yield pd.DataFrame(made, columns=[label, *names])

    return base.unionByName(merged.mapInPandas(make, base.schema))


def classify(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, classifier: Callable[[], Estimator] | None = None, balance: str | None = None) -> dict[str, DataFrame]:
    """Stratified k-fold cross validation. {'predictions': key, fold, truth, predicted, probabilities; 'reports': by fold;
    'report': their mean; 'confusion'}. Without a classifier (which must use columns ``__features`` and ``__label``):
    logistic regression of two classes; more are NotImplementedError."""
    classes = [r[0] for r in df.select(quoted(label)).where(quoted(label).isNotNull()).distinct().orderBy(quoted(label)).collect()]
    if classifier is None and len(classes) > 2:
        raise NotImplementedError("name a classifier for more than two classes")
    make = classifier or (lambda: LogisticRegression(maxIter=200, featuresCol="__features", labelCol="__label"))
    spark = df.sparkSession
    codes = spark.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], f"`{label}` {dict(df.dtypes)[label]}, __label double")
    dealt = folds(df.where(quoted(label).isNotNull()), label, key, k)
    done, reports = [], []
    for f in range(k):
        train, test = dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f)
        if balance:
            train = smote(train, features, label, key, balance)
        model = make().fit(_vectors(train.join(F.broadcast(codes), label), features))
        names = F.array(*[F.lit(c) for c in classes])
        out = model.transform(_vectors(test.join(F.broadcast(codes), label), features))
        out = out.select(quoted(key), "fold", quoted(label).alias("truth"), F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"), vector_to_array("probability").alias("probabilities"))
        done.append(out)
        counts = out.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
        grid = codes.select(quoted(label).alias("truth")).crossJoin(codes.select(quoted(label).alias("predicted")))
        reports.append(report(grid.join(counts, ["truth", "predicted"], "left").fillna(0, ["n"])).withColumn("fold", F.lit(f)))
    every, all_reports = done[0], reports[0]
    for d, r in zip(done[1:], reports[1:]):
        every, all_reports = every.unionByName(d), all_reports.unionByName(r)
    text = isinstance(classes[0], str)
    counts = confusion(every, "truth", "predicted", classes if text else [int(c) for c in classes])
    return {"predictions": every, "reports": all_reports, "report": mean_report(all_reports), "confusion": counts}


def detection_forest(df: DataFrame, features: Sequence[str], label: str, background: str, seed: int = 2001):
    """(model, classes): a random forest on detection features; the background class comes last, and a detection's
    probability is 1 minus its."""
    classes = [r[0] for r in df.select(quoted(label)).where(quoted(label) != background).distinct().orderBy(quoted(label)).collect()] + [background]
    coded = df.withColumn("__label", F.array_position(F.array(*[F.lit(c) for c in classes]), quoted(label)).cast("double") - 1)
    return RandomForestClassifier(seed=seed, featuresCol="__features", labelCol="__label").fit(_vectors(coded, features)), classes


def forest_detections(df: DataFrame, model, classes: Sequence[str], features: Sequence[str]) -> DataFrame:
    out = model.transform(_vectors(df, features)).withColumn("probabilities", vector_to_array("probability")).drop("__features", "rawPrediction", "probability", "prediction")
    known = F.slice("probabilities", 1, len(classes) - 1)
    return out.withColumn("class_probs", known).withColumn("det_prob", F.aggregate(known, F.lit(0.0), lambda a, b: a + b)).drop("probabilities")
