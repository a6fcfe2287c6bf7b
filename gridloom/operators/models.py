"""Regressions from embeddings to radar values, and the studies built on them.

Models are MLlib estimators over one cached feature frame. Ridge is exact; for many
small ridge fits the normal equations are summed per subset in one pass instead of
fitting one by one.
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.quantiles import exact_quantiles

#: The boosted trees of the study, as far as level-wise trees have the same knobs.
TREES = {"maxIter": 700, "stepSize": 0.03, "maxDepth": 5, "subsamplingRate": 0.85, "minInstancesPerNode": 20, "featureSubsetStrategy": "0.85"}


#: Values of features in one part of a frame that trees are fitted to.
PART_VALUES = 1 << 20


def in_parts(df: DataFrame, keys: list[str], rows: int, width: int) -> DataFrame:
    """``df`` in as many parts as about ``rows`` rows of ``width`` features fill, each in the order of ``keys``, which must be total.

    Every level of every tree takes two stages with a task for each part. As the parts come from the values and not from
    the shuffle's setting, small frames are not cut into many tasks; and the trees' draws, which go by part and place, are the same in every run.
    """
    return df.repartition(max(1, -(-rows * width // PART_VALUES)), *keys).sortWithinPartitions(*keys)


def boosted_trees(target: str, prediction: str, *, features: str = "features", validation: str | None = None, seed: int = 42, **params) -> GBTRegressor:
    gbt = GBTRegressor(featuresCol=features, labelCol=target, predictionCol=prediction, seed=seed, **(TREES | params))
    return gbt.setParams(validationIndicatorCol=validation, validationTol=0.01) if validation else gbt


def fit_multi(train: DataFrame, targets: list[str], parallelism: int = 3, **params) -> PipelineModel:
    """One booster per band, fitted side by side; predictions go to ``<target>_hat``."""
    with ThreadPoolExecutor(parallelism) as pool:
        models = list(pool.map(lambda t: boosted_trees(t, f"{t}_hat", **params).fit(train.filter(F.col(t).isNotNull())), targets))
    return PipelineModel(models)


def fit_sets(train: DataFrame, sets: list[str], target: str, parallelism: int = 3, **params) -> dict[str, GBTRegressionModel]:
    """One booster for each column of feature vectors, fitted side by side; predictions go to ``<set>_hat``."""
    with ThreadPoolExecutor(parallelism) as pool:
        return dict(zip(sets, pool.map(lambda s: boosted_trees(target, f"{s}_hat", features=s, **params).fit(train), sets), strict=True))


def ridge(train: DataFrame, target: str, prediction: str, *, alpha: float = 1.0, features: str = "features"):
    """Ridge with an unpenalised intercept on unscaled features, as closed form.

    MLlib scales the penalty by the rows and by the target's spread; both are undone here.
    """
    s = train.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("s")).first()
    return LinearRegression(featuresCol=features, labelCol=target, predictionCol=prediction, elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * (s.s or 1.0) / max(s.n, 1)).fit(train)


def log_ridge(train: DataFrame, target: str, prediction: str, **options):
    """Ridge on the logarithm; :func:`predict_log` turns predictions back."""
    return ridge(train.withColumn("_log_target", F.ln(target)), "_log_target", prediction, **options)


def predict_log(model, df: DataFrame, prediction: str) -> DataFrame:
    return model.transform(df).withColumn(prediction, F.exp(prediction))


def structural_difference(df: DataFrame, vv_hat: str, vh_hat: str, name: str) -> DataFrame:
    """The difference that two predictions imply."""
    return df.withColumn(name, F.col(vv_hat) - F.col(vh_hat))


def gramian(df: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """Per subset the sums of products of (1, features, target), enough for any ridge fit; one pass, partial sums before the shuffle."""
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(target).cast("double")]
    sums = [F.sum(a * b) for i, a in enumerate(columns) for b in columns[i:]]
    return df.filter(F.col(target).isNotNull()).groupBy(*keys).agg(F.array(*sums).alias("sums"))


def ridge_from_gramian(sums: list[float], width: int, alpha: float) -> np.ndarray:
    """Intercept and coefficients from the sums of one subset."""
    m = np.zeros((width + 2, width + 2))
    m[np.triu_indices(width + 2)] = sums
    m = m + np.triu(m, 1).T
    n, xs, ys = m[0, 0], m[0, 1:-1], m[0, -1]
    xx, xy = m[1:-1, 1:-1] - np.outer(xs, xs) / n, m[1:-1, -1] - xs * ys / n
    w = np.linalg.solve(xx + alpha * np.eye(width), xy)
    return np.concatenate([[(ys - w @ xs) / n], w])


def ridge_fits(df: DataFrame, keys: list[str], features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """(keys, coefficients): one ridge fit for every subset, from one pass. Subsets are folds, seeds and fractions: a bounded design."""
    sums = gramian(df, keys, features, target)
    fields = [df.schema[k] for k in keys] + [T.StructField("coefficients", T.ArrayType(T.DoubleType()))]

    def run(frames):
        for frame in frames:
            frame["coefficients"] = [ridge_from_gramian(list(s), len(features), alpha).tolist() for s in frame["sums"]]
            yield frame.drop(columns="sums")

    return sums.mapInPandas(run, T.StructType(fields))


def ridge_predict(df: DataFrame, features: list[str], name: str, coefficients: str = "coefficients") -> DataFrame:
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    return df.withColumn(name, F.aggregate(F.zip_with(x, F.col(coefficients), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def reconstruct(pixels: DataFrame, is_train: Column, model: PipelineModel, targets: list[str], predict_all: bool = False) -> DataFrame:
    """Every valid pixel with ``is_train`` and, per band, ``<band>_filled``: observed at training pixels, predicted elsewhere.

    What a pixel is in follows from the pixel itself, so that no pixel is moved to learn it.
    """
    out = model.transform(pixels.withColumn("is_train", F.coalesce(is_train, F.lit(False))))
    copy = F.lit(False) if predict_all else F.col("is_train")
    return out.withColumns({f"{t}_filled": F.when(copy, F.col(t).cast("double")).otherwise(F.col(f"{t}_hat")) for t in targets})


def best_iteration(errors: list[float], patience: int = 100) -> int:
    """How many trees to keep: the first of least error, before ``patience`` more trees have brought no better one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def truncated(model: GBTRegressionModel, trees: int) -> GBTRegressionModel:
    """The same model with its first trees only."""
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    kind = gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    kept = gateway.new_array(kind, trees)
    weights = gateway.new_array(gateway.jvm.double, trees)
    for i in range(trees):
        kept[i], weights[i] = java.trees()[i], float(java.treeWeights()[i])
    cut = gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(model.uid, kept, weights)
    cut.setFeaturesCol(model.getFeaturesCol())
    cut.setPredictionCol(model.getPredictionCol())
    return GBTRegressionModel(cut)


def fit_with_patience(train: DataFrame, held: DataFrame, target: str, prediction: str, *, patience: int = 100, features: str = "features", **params) -> tuple[GBTRegressionModel, list[float]]:
    """(model, errors): boosted trees, cut where the error on held rows was least; the error after each tree comes from one scoring pass."""
    model = boosted_trees(target, prediction, features=features, **params).fit(train)
    errors = list(model.evaluateEachIteration(held, "squared"))
    return truncated(model, best_iteration(errors, patience)), errors


def random_search(df: DataFrame, target: str, fold: str, space: dict[str, list], trials: int, *, features: str = "features", seed: int = 42, parallelism: int = 4, patience: int = 100) -> DataFrame:
    """(trial, params, mean_rmse, std_rmse, mean_trees) of seeded random settings by grouped folds, best first.

    Every fold of a trial is fitted with all its trees, cut with patience on the fold and scored there; fits run side by side over the cached frame.
    """
    r = random.Random(seed)
    settings = [{k: r.choice(v) for k, v in sorted(space.items())} for _ in range(trials)]
    folds = [x[0] for x in df.select(fold).distinct().orderBy(fold).collect()]
    parts = {f: (df.filter(F.col(fold) != f).cache(), df.filter(F.col(fold) == f).cache()) for f in folds}

    def score(job: tuple[dict, int]) -> tuple[float, int]:
        params, f = job
        model, errors = fit_with_patience(*parts[f], target, "_p", patience=patience, features=features, seed=seed, **params)
        kept = model.getNumTrees
        return float(np.sqrt(errors[kept - 1])), kept

    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(score, [(p, f) for p in settings for f in folds]))
    for pair in parts.values():
        for part in pair:
            part.unpersist()
    rows = []
    for i, p in enumerate(settings):
        own = scores[i * len(folds) : (i + 1) * len(folds)]
        rows.append((i, str(p), float(np.mean([s for s, _ in own])), float(np.std([s for s, _ in own])), float(np.mean([k for _, k in own]))))
    return df.sparkSession.createDataFrame(rows, "trial int, params string, mean_rmse double, std_rmse double, mean_trees double").orderBy("mean_rmse", "trial")


def gain_importance(df: DataFrame, model, features: list[str]) -> DataFrame:
    """(feature, gain, splits): the trees' gain shares, and how often each feature splits."""
    splits = dict.fromkeys(range(len(features)), 0)

    def walk(node) -> None:
        if node.subtreeDepth() > 0:
            splits[node.split().featureIndex()] += 1
            walk(node.leftChild())
            walk(node.rightChild())

    for tree in model.trees:
        walk(tree._call_java("rootNode"))
    gain = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(gain[i]), splits[i]) for i, f in enumerate(features)], "feature string, gain double, splits int")


def rgb_projection(df: DataFrame, vector: str = "features", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Three principal components, each stretched between two percentiles to [0, 1]: columns c1, c2, c3."""
    from pyspark.ml.functions import vector_to_array

    projected = PCA(k=3, inputCol=vector, outputCol="_pc").fit(df).transform(df).withColumn("_pc", vector_to_array("_pc"))
    projected = projected.withColumns({f"_{i}": F.col("_pc")[i] for i in range(3)})
    long = projected.select(F.posexplode(F.array(*[f"_{i}" for i in range(3)])).alias("i", "v"))
    found = exact_quantiles(long, ["i"], "v", [low, high])
    limits = found.agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"_l{i}") for i in range(3)])
    out = projected.crossJoin(F.broadcast(limits))
    scaled = {f"c{i + 1}": F.least(F.greatest((F.col(f"_{i}") - F.col(f"_l{i}")[0]) / F.when(F.col(f"_l{i}")[1] > F.col(f"_l{i}")[0], F.col(f"_l{i}")[1] - F.col(f"_l{i}")[0]).otherwise(1.0), F.lit(0.0)), F.lit(1.0)) for i in range(3)}
    return out.withColumns(scaled).drop("_pc", *[f"_{i}" for i in range(3)], *[f"_l{i}" for i in range(3)])
