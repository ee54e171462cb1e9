"""Training and scoring jobs: regression, classification, projection, k-means, model tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.plans.scale import checkpoint

MAX_WIDTH = 4096  # widest feature vector whose width x width matrices are held on the driver


def as_vector(df: DataFrame, features: str, out: str = "_features") -> DataFrame:
    """`features` (array or vector) as an ML vector."""
    if isinstance(df.schema[features].dataType, VectorUDT):
        return df.withColumn(out, F.col(features))
    return df.withColumn(out, array_to_vector(F.col(features).cast("array<double>")))


def as_array(df: DataFrame, features: str) -> Column:
    if isinstance(df.schema[features].dataType, VectorUDT):
        return vector_to_array(features)
    return F.col(features).cast("array<double>")


def width_of(df: DataFrame, features: str) -> int:
    row = df.select(F.size(as_array(df, features)).alias("n")).where("n > 0").first()
    width = row["n"] if row else 0
    if width > MAX_WIDTH:
        raise ValueError(f"{width} features; at most {MAX_WIDTH} are supported")
    return width


def dot(a: Column, weights: Sequence[float]) -> Column:
    """Inner product with a fixed weight vector."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(a, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


# -- model tables ---------------------------------------------------------------------

def save_model(model: DataFrame, path: str, model_id: str) -> None:
    """Model rows under their id; saving the same id again replaces them."""
    out = model.withColumn("_model_id", F.lit(model_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_model_id").parquet(path)


def load_model(spark: SparkSession, path: str, model_id: str | None = None) -> DataFrame | None:
    try:
        df = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    df = df if model_id is None else df.where(F.col("_model_id") == model_id)
    return None if df.isEmpty() else df


def fit_or_load(df: DataFrame, path: str, model_id: str, fit: Callable[[DataFrame], DataFrame],
                score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Score with the stored model; train and store one first when there is none."""
    model = load_model(df.sparkSession, path, model_id)
    if model is None:
        save_model(fit(df), path, model_id)
        model = load_model(df.sparkSession, path, model_id)
    return score(df, model)


# -- regression -------------------------------------------------------------------------

LINEAR = "intercept double, type string, size int, data array<double>"


def train_linear(df: DataFrame, features: str, label: str, reg: float = 0.001, weight: str | None = None,
                 solver: str = "normal", max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """Weighted least squares with an L2 penalty (or gradient steps with solver `l-bfgs`) as one model row."""
    ready = as_vector(df, features).select("_features", F.col(label).cast("double").alias("_label"),
                                           *([F.col(weight).cast("double").alias("_weight")] if weight else []))
    learner = LinearRegression(featuresCol="_features", labelCol="_label", regParam=reg, elasticNetParam=0.0, solver=solver,
                               maxIter=max_iter, tol=tol, standardization=True)
    if weight:
        learner = learner.setWeightCol("_weight")
    fitted = learner.fit(ready)
    row = (float(fitted.intercept), "dense", int(fitted.coefficients.size), [float(x) for x in fitted.coefficients.toArray()])
    return df.sparkSession.createDataFrame([row], LINEAR)


def score_linear(df: DataFrame, model: DataFrame, features: str, out: str = "label") -> DataFrame:
    row = model.select("intercept", "data").first()
    return df.withColumn(out, dot(as_array(df, features), row["data"]) + F.lit(row["intercept"]))


def train_test(df: DataFrame, share: float = 0.6, seed: int = 2000) -> tuple[DataFrame, DataFrame]:
    return tuple(df.randomSplit([share, 1 - share], seed=seed))


def squared_residuals(df: DataFrame, model: DataFrame, features: str, label: str) -> DataFrame:
    scored = score_linear(df, model, features, "_p")
    return scored.agg(F.sum(F.pow(F.col(label) - F.col("_p"), 2)).alias("ssr"))


def polynomial(df: DataFrame, features: str, degree: int, out: str = "poly") -> DataFrame:
    """All exponent combinations of the features with total degree 1 to `degree`."""
    ready = as_vector(df, features)
    return PolynomialExpansion(degree=degree, inputCol="_features", outputCol=out).transform(ready).drop("_features")


def train_logistic(df: DataFrame, features: str, label: str, reg: float = 0.01, max_iter: int = 50):
    ready = as_vector(df, features)
    return LogisticRegression(featuresCol="_features", labelCol=label, regParam=reg, maxIter=max_iter).fit(ready)


def score_logistic(df: DataFrame, fitted, features: str, out: str = "prediction") -> DataFrame:
    """Most likely class (0, 1, ...) by the fitted margins, as plain column expressions."""
    matrix, offsets = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    x = as_array(df, features)
    margins = [dot(x, row) + F.lit(float(b)) for row, b in zip(matrix, offsets)]
    if len(margins) == 1:
        return df.withColumn(out, F.when(margins[0] > 0, 1.0).otherwise(0.0))
    best = F.array_max(F.array(*[F.struct(m.alias("m"), F.lit(-i).alias("i")) for i, m in enumerate(margins)]))
    return df.withColumn(out, (-best.getField("i")).cast("double"))


def train_glm(df: DataFrame, features: str, label: str, family: str = "gaussian", link: str | None = None, reg: float = 0.0):
    ready = as_vector(df, features)
    learner = GeneralizedLinearRegression(featuresCol="_features", labelCol=label, family=family, regParam=reg)
    return (learner.setLink(link) if link else learner).fit(ready)


# -- linear classification -----------------------------------------------------------------

SVM = "positive string, negative string, threshold double, weight array<double>, n long, accuracy double"


def _svm_row(df: DataFrame, positive: str, negative: str, reg: float, max_iter: int):
    fitted = LinearSVC(featuresCol="_features", labelCol="_y", maxIter=max_iter, regParam=reg).fit(df)
    weight = [float(x) for x in fitted.coefficients.toArray()]
    score = dot(vector_to_array("_features"), weight)
    hit = (score > F.lit(-float(fitted.intercept))).cast("double")
    stat = df.agg(F.count(F.lit(1)).alias("n"), (1 - F.sum(F.abs(F.col("_y") - hit)) / F.count(F.lit(1))).alias("a")).first()
    return positive, negative, -float(fitted.intercept), weight, int(stat["n"]), float(stat["a"])


def train_svm(df: DataFrame, features: str, label: str, reg: float = 0.01, max_iter: int = 50,
              max_labels: int = 50) -> DataFrame:
    """Two classes give one model row. More give one row per label pair and one per label against
    all others (positive = negative = the label)."""
    # written once: every model below reads it again
    ready = checkpoint(as_vector(df, features).select("_features", F.col(label).cast("string").alias("_text")))
    labels = sorted(r[0] for r in ready.select("_text").distinct().limit(max_labels + 1).collect())
    if len(labels) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    rows = []
    if len(labels) == 2:
        y = F.when(F.col("_text") == labels[1], 1.0).otherwise(0.0)
        rows.append(_svm_row(ready.withColumn("_y", y), labels[1], labels[0], reg, max_iter))
    else:
        for a, b in itertools.combinations(labels, 2):
            part = ready.where(F.col("_text").isin(a, b)).withColumn("_y", F.when(F.col("_text") == a, 1.0).otherwise(0.0))
            rows.append(_svm_row(part, a, b, reg, max_iter))
        for a in labels:
            y = F.when(F.col("_text") == a, 1.0).otherwise(0.0)
            rows.append(_svm_row(ready.withColumn("_y", y), a, a, reg, max_iter))
    return df.sparkSession.createDataFrame(rows, SVM)


def vote(hits: Column, models: Sequence[tuple[str, str]]) -> Column:
    """Label of a row from `hits`, an array with one boolean per model row in table order.

    The first one-against-all row that hits names the label to begin with, else the first pair's. A label's first pair
    decides on it: a hit keeps the label, a miss hands over to the pair's other label, if that has a pair further on.
    So every pair row is one CASE over the verdicts of later rows.
    """
    pairs = [(i, a, b) for i, (a, b) in enumerate(models) if a != b]
    verdict: dict[str, Column] = {}  # of labels whose deciding pair stands further on
    for i, a, b in reversed(pairs):
        if i == next(j for j, first, _ in pairs if first == a):
            verdict[a] = F.when(F.get(hits, F.lit(i)), F.lit(a)).otherwise(verdict.get(b, F.lit(b)))
    result = verdict[pairs[0][1]] if pairs else F.lit(None).cast("string")
    for i, (a, b) in reversed(list(enumerate(models))):
        if a == b:
            result = F.when(F.get(hits, F.lit(i)), verdict.get(a, F.lit(a))).otherwise(result)
    return result


def score_svm(df: DataFrame, model: DataFrame, features: str, out: str = "label") -> DataFrame:
    rows = model.select("positive", "negative", "threshold", "weight").collect()
    if not rows:
        raise ValueError("the model has no rows")
    array = as_array(df, features)
    if len(rows) == 1:
        only = rows[0]
        hit = dot(array, only["weight"]) > F.lit(only["threshold"])
        return df.withColumn(out, F.when(hit, only["positive"]).otherwise(only["negative"]))
    hits = F.array(*[dot(array, r["weight"]) > F.lit(r["threshold"]) for r in rows])
    heads = [(r["positive"], r["negative"]) for r in rows]
    # bound to a name, so that the products are taken once a row
    return df.withColumn(out, F.transform(F.array(hits), lambda h: vote(h, heads))[0])


# -- moments and projections ------------------------------------------------------------------

def gram(df: DataFrame, array: Column, width: int, centre_rows: bool = False) -> np.ndarray:
    """Sum of outer products x xᵀ over all rows: per partition in numpy, then one sum per cell."""

    def partial(frames):
        import pandas as pd

        total = np.zeros((width, width))
        for frame in frames:
            if len(frame):
                x = np.vstack(frame["x"].to_numpy())
                if centre_rows:
                    x = x - x.mean(axis=1, keepdims=True)
                total += x.T @ x
        i, j = np.triu_indices(width)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total[i, j]})

    cells = df.select(array.alias("x")).mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in cells.collect():  # width x width numbers, width is checked
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def sums_of(df: DataFrame, array: Column, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Row count and element sums per key."""
    with_x = df.select(*keys, array.alias("_x"))
    return with_x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("_x", F.lit(i))) for i in range(width)]).alias("s"))


PROJECTION = "k int, row int, col int, eigenvalues array<double>, eigenvectors array<double>, mean array<double>"


def _projection_row(spark, values: np.ndarray, vectors: np.ndarray, mean: np.ndarray, k: int) -> DataFrame:
    row = (k, vectors.shape[0], k, [float(v) for v in values[:k]], [float(v) for v in vectors[:, :k].ravel()], [float(m) for m in mean])
    return spark.createDataFrame([row], PROJECTION)


def components_for(values: np.ndarray, share: float) -> int:
    """Fewest leading components that explain more than `share`."""
    part = np.cumsum(values) / values.sum()
    return int(np.searchsorted(part, share, side="right") + 1) if part[-1] > share else len(values)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive."""
    at = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def train_pca(df: DataFrame, features: str, k: int | None = None, share: float = 0.85) -> DataFrame:
    """Leading components of the covariance; without `k`, as many as explain more than `share`."""
    width = width_of(df, features)
    x = as_array(df, features)
    row = sums_of(df, x, width).first()
    n, mean = row["n"], np.array(row["s"]) / row["n"]
    covariance = (gram(df, x, width) - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.clip(values[::-1], 0, None), _signed(vectors[:, ::-1])
    return _projection_row(df.sparkSession, values, vectors, mean, k or components_for(values, share))


def train_row_centred_pca(df: DataFrame, features: str, k: int) -> DataFrame:
    """Components of rows centred by their own mean. The eigenvalues of all row-by-row products are
    those of the much smaller feature-by-feature matrix, so no pair of rows is formed."""
    width = width_of(df, features)
    values, vectors = np.linalg.eigh(gram(df, as_array(df, features), width, centre_rows=True))
    values, vectors = np.clip(values[::-1], 0, None), _signed(vectors[:, ::-1])
    return _projection_row(df.sparkSession, values, vectors, np.zeros(width), k)


def train_lda(df: DataFrame, features: str, label: str, k: int) -> DataFrame:
    """Directions that separate the classes: eig(Sw⁻¹ Sb), largest |λ| first."""
    width = width_of(df, features)
    x = as_array(df, features)
    rows = sums_of(df, x, width, [label]).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many classes")
    n = sum(r["n"] for r in rows)
    mean = sum(np.array(r["s"]) for r in rows) / n
    between, inside = np.zeros((width, width)), gram(df, x, width)
    for r in rows:
        m = np.array(r["s"]) / r["n"]
        inside -= r["n"] * np.outer(m, m)
        between += r["n"] * np.outer(m - mean, m - mean)
    values, vectors = np.linalg.eig(np.linalg.pinv(inside) @ between)
    order = np.argsort(-np.abs(values))
    return _projection_row(df.sparkSession, np.real(values[order]), _signed(np.real(vectors[:, order])), mean * 0, k)


def project(df: DataFrame, model: DataFrame, features: str = "vector", out: str = "vector") -> DataFrame:
    """Projection of a vector column by a PCA or LDA model row."""
    row = model.first()
    matrix = np.array(row["eigenvectors"]).reshape(row["row"], row["col"])
    mean = np.array(row["mean"])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(vectors):
        import pandas as pd

        return pd.Series(list((np.vstack(vectors.to_numpy()) - mean) @ matrix)) if len(vectors) else pd.Series([], dtype=object)

    return df.withColumn(out, apply(as_array(df, features)))


# -- k-means ---------------------------------------------------------------------------------

def assign(df: DataFrame, features: str, centroids: np.ndarray, out: str = "cluster") -> DataFrame:
    fixed = np.asarray(centroids, dtype=float)
    norms = (fixed ** 2).sum(axis=1)

    @F.pandas_udf("int")
    def pick(vectors):
        import pandas as pd

        x = np.vstack(vectors.to_numpy())
        return pd.Series((norms - 2 * (x @ fixed.T)).argmin(axis=1).astype("int32"))

    return df.withColumn(out, pick(as_array(df, features)))


def kmeans(df: DataFrame, features: str, centroids: Sequence[Sequence[float]], iterations: int) -> np.ndarray:
    """Fixed number of rounds from given centroids; an empty cluster keeps its centroid."""
    centres = np.asarray(centroids, dtype=float)
    width = centres.shape[1]
    for _ in range(iterations):
        assigned = assign(df, features, centres)
        for r in sums_of(assigned, as_array(assigned, features), width, ["cluster"]).collect():
            centres[r["cluster"]] = np.array(r["s"]) / r["n"]
    return centres
