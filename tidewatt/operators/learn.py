"""Linear-algebra summaries and fitted models."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tidewatt.functions.values import quoted
from tidewatt.operators.ordered import time_split, with_length
from tidewatt.plans.quantiles import known
from tidewatt.plans.sizing import attach, same_keys
from tidewatt.session import freeze
from tidewatt.spec import SeriesSpec


def _square(flat, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = np.asarray(flat, dtype=float)
    return out + np.triu(out, 1).T


def _complete(df: DataFrame, columns, keys) -> DataFrame:
    rows = df.select(*keys, *[known(quoted(c)).alias(c) for c in columns])
    return rows.na.drop(subset=list(columns))


def _name_values(columns, values: Column) -> Column:
    names = F.array(*[F.lit(c) for c in columns])
    return F.explode(F.arrays_zip(names.alias("column"), values.alias("value")))


def vif(df: DataFrame, columns, keys=(), center: bool = False) -> DataFrame:
    """Variance inflation factor of each column over complete rows.

    Without ``center`` the regressions have no intercept. Only the p x p matrix of products
    leaves the aggregation; it is inverted in a batch over the keys.
    """
    columns, keys = list(columns), list(keys)
    rows, p = _complete(df, columns, keys), len(columns)
    pairs = list(combinations_with_replacement(columns, 2))
    if center:
        cells = [F.covar_pop(a, b) for a, b in pairs]
    else:
        cells = [F.avg(quoted(a) * quoted(b)) for a, b in pairs]
    gram = rows.groupBy(*keys).agg(F.array(*cells).alias("_g"))

    @F.pandas_udf("array<double>")
    def inflate(flat: pd.Series) -> pd.Series:
        out = []
        for g in flat:
            g = _square(g, p)
            scale = np.sqrt(np.diag(g))
            if not np.isfinite(g).all() or (scale == 0).any():
                out.append([None] * p)
                continue
            unit = g / np.outer(scale, scale)
            singular = np.linalg.matrix_rank(unit) < p
            out.append([float("inf")] * p if singular else np.diag(np.linalg.inv(unit)).tolist())
        return pd.Series(out)

    out = gram.select(*keys, _name_values(columns, inflate("_g")).alias("_v"))
    return out.select(*keys, F.col("_v.column").alias("column"), F.col("_v.value").alias("vif"))


def pca_variance(df: DataFrame, columns, k: int = 5, keys=(), impute: bool = False) -> DataFrame:
    """Share of variance along the first principal components (centred, not scaled)."""
    columns, keys = list(columns), list(keys)
    if impute:
        rows = df.select(*keys, *[known(quoted(c)).alias(c) for c in columns])
        means = rows.groupBy(*keys).agg(*[F.avg(quoted(c)).alias(f"{c}#m") for c in columns])
        rows = attach(rows, means, keys).select(*keys, *[F.coalesce(quoted(c), quoted(f"{c}#m")).alias(c) for c in columns])
    else:
        rows = _complete(df, columns, keys)
    p, top = len(columns), min(k, len(columns))
    pairs = combinations_with_replacement(columns, 2)
    cov = rows.groupBy(*keys).agg(F.array(*[F.covar_pop(quoted(a), quoted(b)) for a, b in pairs]).alias("_g"))

    @F.pandas_udf("array<double>")
    def ratios(flat: pd.Series) -> pd.Series:
        out = []
        for g in flat:
            values = np.sort(np.linalg.eigvalsh(_square(g, p)))[::-1].clip(min=0)
            total = values.sum()
            out.append((values[:top] / total).tolist() if total > 0 else [None] * top)
        return pd.Series(out)

    out = cov.select(*keys, F.posexplode(ratios("_g")).alias("_i", "explained_variance_ratio"))
    return out.select(*keys, (F.col("_i") + 1).cast("bigint").alias("component"), "explained_variance_ratio")


def discriminant_variance(df: DataFrame, columns, target: str) -> DataFrame:
    """Linear discriminant analysis: share of between-class variance along each axis.

    Class sizes, means and covariances are aggregated per class and summed into the within
    and between scatter; the classes themselves never meet in one task.
    """
    columns = list(columns)
    rows, p = _complete(df.filter(F.col(target).isNotNull()), columns, [target]), len(columns)
    pairs = list(combinations_with_replacement(range(p), 2))
    per_class = rows.groupBy(target).agg(
        F.count("*").alias("_n"), *[F.avg(quoted(c)).alias(f"_m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(quoted(columns[i]), quoted(columns[j])).alias(f"_c{i}_{j}") for i, j in pairs],
    )
    overall = per_class.agg(*[(F.sum(F.col(f"_m{i}") * F.col("_n")) / F.sum("_n")).alias(f"_g{i}") for i in range(p)])
    joined = per_class.crossJoin(F.broadcast(overall))
    off = [F.col(f"_m{i}") - F.col(f"_g{i}") for i in range(p)]
    sums = joined.agg(
        F.count("*").alias("n_classes"),
        F.array(*[F.sum(F.col("_n") * F.col(f"_c{i}_{j}")) for i, j in pairs]).alias("_within"),
        F.array(*[F.sum(F.col("_n") * off[i] * off[j]) for i, j in pairs]).alias("_between"),
    )

    @F.pandas_udf("array<double>")
    def ratios(within: pd.Series, between: pd.Series, classes: pd.Series) -> pd.Series:
        out = []
        for w, b, c in zip(within, between, classes):
            w, b, top = _square(w, p), _square(b, p), int(min(p, c - 1))
            values, vectors = np.linalg.eigh(w)
            keep = values > values.max() * 1e-12 if values.max() > 0 else np.zeros(p, bool)
            white = vectors[:, keep] / np.sqrt(values[keep])
            axes = np.sort(np.linalg.eigvalsh(white.T @ b @ white))[::-1].clip(min=0)[:top]
            out.append((axes / axes.sum()).tolist() if axes.sum() > 0 else [])
        return pd.Series(out)

    share = F.posexplode(ratios("_within", "_between", "n_classes")).alias("_i", "explained_variance_ratio")
    return sums.select("n_classes", share).select(
        F.lit(target).alias("target"), "n_classes", (F.col("_i") + 1).cast("bigint").alias("axis"), "explained_variance_ratio"
    )


def residual_model(
    df: DataFrame, spec: SeriesSpec, features, target: str = "residual", train: float = 0.8, trees: int = 500,
    rate: float = 0.05, min_rows: int = 50, seed: int = 42,
):
    """Gradient-boosted trees for what the physical model leaves unexplained.

    Complete rows are split by time; returns the fitted pipeline and the validation rows
    with their ``prediction``.
    """
    features = list(features)
    complete = df.na.drop(subset=[*features, target])
    # Every boosting round reads the rows again, so the feature table is written once.
    labelled = freeze(time_split(complete, spec, train).withColumn("_label", F.col(target).cast("double")))
    if labelled.limit(min_rows).count() < min_rows:
        raise ValueError("not enough complete rows to train the residual model")
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    booster = GBTRegressor(featuresCol="_features", labelCol="_label", maxIter=trees, stepSize=rate, seed=seed)
    model = Pipeline(stages=[assembler, booster]).fit(labelled.filter("split = 'train'"))
    scored = model.transform(labelled.filter("split = 'validate'")).drop("_features", "_label")
    return model, scored


def feature_importance(spark, model) -> DataFrame:
    """Feature names with their share in the fitted trees (one row per feature)."""
    assembler, booster = model.stages
    shares = booster.featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(assembler.getInputCols(), shares)]
    return spark.createDataFrame(rows, "feature string, importance double")


def hybrid_correction(
    df: DataFrame, scored: DataFrame, join_on, physics: str = "soc_physics", prediction: str = "prediction", name: str = "soc_hybrid"
) -> DataFrame:
    """Physical value plus the predicted residual where there is one."""
    slim = scored.select(*join_on, F.col(prediction).alias("_p"), F.lit(True).alias("corrected"))
    joined = same_keys(df, slim, list(join_on))
    return joined.withColumn(name, F.col(physics) + F.coalesce("_p", F.lit(0.0))).withColumn(
        "corrected", F.coalesce("corrected", F.lit(False))
    ).drop("_p")


def ridge_fit(
    df: DataFrame, spec: SeriesSpec, features, target: str, alphas=(0.1, 1.0, 10.0), folds: int = 3, min_rows: int = 5
) -> DataFrame:
    """Ridge regression on standardised features, penalty chosen by contiguous k-fold R2.

    Each fold contributes its sums of products; the choice and the fit use only those.
    """
    features, keys = list(features), list(spec.keys)
    rows = df.na.drop(subset=[*features, target])
    placed = with_length(rows, spec)
    base, extra = F.floor(F.col("n_rows") / folds), F.pmod(F.col("n_rows"), F.lit(folds).cast("bigint"))
    edge = extra * (base + 1)
    fold = F.when(F.col("idx") < edge, F.floor(F.col("idx") / (base + 1))).otherwise(
        extra + F.floor((F.col("idx") - edge) / F.greatest(base, F.lit(1)))
    )
    stats = rows.groupBy(*keys).agg(
        *[F.avg(quoted(f)).alias(f"{f}#m") for f in features], *[F.stddev_pop(quoted(f)).alias(f"{f}#s") for f in features]
    )
    z = attach(placed.withColumn("_fold", fold), stats, keys)
    scaled = [(quoted(f) - quoted(f"{f}#m")) / F.when(quoted(f"{f}#s") > 0, quoted(f"{f}#s")).otherwise(1.0) for f in features]
    columns = [F.lit(1.0), *scaled, quoted(target).cast("double")]
    p = len(columns)
    products = [F.sum(columns[i] * columns[j]) for i, j in combinations_with_replacement(range(p), 2)]
    gram = z.groupBy(*keys, "_fold").agg(F.array(*products).alias("_g"))
    folded = gram.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_fold", "_g"))), lambda s: s["_g"]).alias("_gs"))

    def solve(g: np.ndarray, alpha: float) -> np.ndarray:
        """Intercept and coefficients from the moment matrix; the intercept is not penalised."""
        n, mean = g[0, 0], g[0] / g[0, 0]
        centred = g - n * np.outer(mean, mean)
        coef = np.linalg.solve(centred[1:-1, 1:-1] + alpha * np.eye(p - 2), centred[1:-1, -1])
        return np.concatenate([[mean[-1] - mean[1:-1] @ coef], coef])

    def r2(g: np.ndarray, beta: np.ndarray) -> float:
        v = np.concatenate([beta, [-1.0]])
        total = g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
        return 1.0 - (v @ g @ v) / total if total > 0 else np.nan

    @F.pandas_udf("alpha double, intercept double, r2 double, n_rows bigint, coef array<double>")
    def fit(batches: pd.Series) -> pd.DataFrame:
        out = []
        for flats in batches:
            parts = [_square(f, p) for f in flats]
            whole = sum(parts)
            if whole[0, 0] < min_rows or len(parts) < folds:
                out.append((None, None, None, int(whole[0, 0]), None))
                continue
            scores = [np.mean([r2(g, solve(whole - g, a)) for g in parts]) for a in alphas]
            alpha = alphas[int(np.argmax(scores))]
            beta = solve(whole, alpha)
            out.append((alpha, beta[0], r2(whole, beta), int(whole[0, 0]), beta[1:].tolist()))
        return pd.DataFrame(out, columns=["alpha", "intercept", "r2", "n_rows", "coef"])

    return folded.select(*keys, fit("_gs").alias("_f")).select(*keys, "_f.*")
