"""PCA by explained variance, two-means of each group, and the proposal to split a file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: below so many vectors nothing is reduced
MIN_ROWS = 10
SEEDS, MAX_ITER, SEED = 30, 3000, 42
MIN_FUNCTIONS = 4
#: rows of a product in two-means, and what counts as near beside its rounding
ROWS, NEAR = 4096, 1e-9


def components_for(explained: list[float], variance: float) -> int:
    """How many components explain ``variance``: the first that reach it, at most all."""
    return min(int(np.searchsorted(np.cumsum(explained), variance)) + 1, len(explained))


def fit_pca(vectors: DataFrame, vec_col: str = "embedding", variance: float = 0.99):
    """``(model, mean, n)`` or None below ``MIN_ROWS`` vectors.

    The covariance is one aggregate over the table (dimensions squared, whatever the rows).
    """
    rows = vectors.where(F.col(vec_col).isNotNull()).select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    count, mean = rows.agg(F.count("*"), Summarizer.mean(F.col("v"))).first()
    if count < MIN_ROWS:
        return None
    k = len(mean)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    explained = model.explainedVariance.toArray().tolist()[: min(k, count)]
    return model, mean.toArray(), components_for(explained, variance)


def transform_pca(df: DataFrame, fitted, vec_col: str = "embedding", to: str = "reduced") -> DataFrame:
    """``df`` with the centred projection on the first components; as it is where nothing was fitted."""
    if fitted is None:
        return df.withColumn(to, F.col(vec_col).cast("array<double>"))
    model, mean, n = fitted
    center = F.array(*[F.lit(float(x)) for x in mean])
    centred = array_to_vector(F.zip_with(F.col(vec_col).cast("array<double>"), center, lambda x, m: x - m))
    projected = model.transform(df.withColumn("v", F.when(F.col(vec_col).isNotNull(), centred)).where("v is not null"))
    return projected.withColumn(to, F.slice(vector_to_array("p"), 1, n)).drop("v", "p")


def gram_pca(x: np.ndarray, variance: float) -> np.ndarray:
    """Centred projection by the smaller of the two products: of the rows where vectors are wider than they are many."""
    c = x - x.mean(axis=0)
    if len(c) < 2 or not c.any():
        return c[:, :1]
    if c.shape[1] <= len(c):
        w, v = np.linalg.eigh(c.T @ c)
        projected = c @ v[:, ::-1]
    else:
        w, v = np.linalg.eigh(c @ c.T)
        projected = v[:, ::-1] * np.sqrt(np.maximum(w[::-1], 0))
    w = np.maximum(w[::-1], 0)
    n = min(components_for((w / w.sum()).tolist(), variance), min(x.shape))
    return projected[:, :n]


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Of each row the nearest center of every run; ``centers`` is (runs, k, dimensions).

    All runs' distances come from products. Where two centers are too near each other for their rounding, the differences decide.
    """
    runs, k, _ = centers.shape
    labels = np.zeros((len(x), runs), np.int32)
    weight = (centers * centers).sum(axis=2)
    for i in range(0, len(x), ROWS):
        part, label = x[i : i + ROWS], labels[i : i + ROWS]
        first = second = None
        for c in range(k):  # squared distances but for the row's own square
            d = weight[:, c] - 2 * (part @ centers[:, c].T)
            if first is None:
                first, second = d, np.full(d.shape, np.inf)
                continue
            closer = d < first
            second = np.where(closer, first, np.minimum(second, d))
            first = np.where(closer, d, first)
            label[closer] = c
        at, run = np.nonzero(second - first <= NEAR * ((part * part).sum(axis=1)[:, None] + weight.max(axis=1)))
        for k0 in range(0, len(at), ROWS):
            r, q = at[k0 : k0 + ROWS], run[k0 : k0 + ROWS]
            label[r, q] = ((part[r][:, None] - centers[q]) ** 2).sum(axis=2).argmin(axis=1)
    return labels


def _means(x: np.ndarray, labels: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The means of all runs' clusters, by a product; an empty cluster keeps its center."""
    runs, k, dim = centers.shape
    sums, sizes = np.zeros((runs, k, dim)), np.zeros((runs, k))
    for i in range(0, len(x), ROWS):
        part, now = x[i : i + ROWS], labels[i : i + ROWS]
        for c in range(k):
            own = (now == c).astype(np.float64)
            sums[:, c] += own.T @ part
            sizes[:, c] += own.sum(axis=0)
    return np.where(sizes[:, :, None] > 0, sums / np.maximum(sizes, 1)[:, :, None], centers)


def two_means(x: np.ndarray, k: int = 2, seeds: int = SEEDS, max_iter: int = MAX_ITER, seed: int = SEED) -> np.ndarray:
    """Labels of the best of ``seeds`` runs (k-means++ starts); all 0 below k points. The runs go on side by side."""
    if len(x) < k:
        return np.zeros(len(x), int)
    rng, starts = np.random.default_rng(seed), []
    for _ in range(seeds):
        centers = x[[rng.integers(len(x))]]
        d = None
        while len(centers) < k:
            new = ((x - centers[-1]) ** 2).sum(axis=1)
            d = new if d is None else np.minimum(d, new)
            centers = np.vstack([centers, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        starts.append(centers)
    centers, labels, open_ = np.stack(starts), np.full((len(x), seeds), -1, np.int32), np.arange(seeds)
    for _ in range(max_iter):
        new = _nearest(x, centers[open_])
        moved = (new != labels[:, open_]).any(axis=0)
        labels[:, open_] = new
        open_ = open_[moved]
        if not len(open_):
            break
        centers[open_] = _means(x, labels[:, open_], centers[open_])
    best, kept = np.inf, labels[:, 0]
    for s in range(seeds):
        cost = ((x - centers[s][labels[:, s]]) ** 2).sum(axis=1).sum()
        if cost < best - 1e-12:
            best, kept = cost, labels[:, s]
    return kept


def clusters(df: DataFrame, group_col: str, ord_col: str, vec_col: str, k: int = 2, variance: float = 0.95) -> DataFrame:
    """``(group, ord, cluster)``: two-means of each group on its own reduced vectors; clusters are numbered by their first member."""
    kind = f"{group_col} {df.schema[group_col].dataType.simpleString()}, {ord_col} bigint, cluster int"

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ord_col, kind="stable")
        x = np.stack([np.asarray(v, float) for v in pdf[vec_col]])
        labels = two_means(gram_pca(x, variance) if len(x) >= MIN_ROWS else x, k)
        first: dict[int, int] = {}
        for label in labels.tolist():
            first.setdefault(label, len(first))
        return pd.DataFrame({group_col: pdf[group_col].to_numpy(), ord_col: pdf[ord_col].to_numpy(), "cluster": [first[x] for x in labels.tolist()]})

    rows = df.where(F.col(vec_col).isNotNull()).select(group_col, F.col(ord_col).cast("bigint").alias(ord_col), F.col(vec_col).cast("array<double>").alias(vec_col))
    return rows.groupBy(group_col).applyInPandas(f, kind)


def split_proposals(df: DataFrame, file_col: str = "file", ord_col: str = "start_line", name_col: str = "name", vec_col: str = "embedding", variance: float = 0.95) -> DataFrame:
    """``(file, cluster, names)``: files of ``MIN_FUNCTIONS`` functions or more in two parts; a file of one part is left out."""
    many = df.where(F.col(vec_col).isNotNull()).groupBy(file_col).count().where(F.col("count") >= MIN_FUNCTIONS).select(file_col)
    parts = clusters(df.join(many, file_col, "left_semi"), file_col, ord_col, vec_col, variance=variance)
    named = parts.join(df.select(file_col, F.col(ord_col).cast("bigint").alias(ord_col), name_col), [file_col, ord_col])
    out = named.groupBy(file_col, "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ord_col, name_col))), lambda x: x[name_col]), ", ").alias("names"))
    two = out.groupBy(file_col).count().where(F.col("count") == 2).select(file_col)
    return out.join(two, file_col, "left_semi")
