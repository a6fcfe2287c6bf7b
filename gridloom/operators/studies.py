"""Ridge studies over many parts of one table, each from a fixed number of passes.

Whatever the number of fractions, seeds, folds, feature sets and targets, a study reads its rows once to
sum products (:mod:`gridloom.operators.gramian`) and, where absolute errors are wanted, once more. Samples of
rising size are nested: rows lie in bins by the order of their draws, and a sample is the
first bins, so its sums are sums over bins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.stats import hash01, regression_metrics
from gridloom.functions.vectors import dot
from gridloom.operators.gramian import Case, absolute_errors, gram_matrices, metrics_of, ridge_weights
from gridloom.operators.sampling import nested_bins, ranks_within
from gridloom.operators.similarity import permuted
from gridloom.sources.scratch import durable

CURVE = "feature_set string, target string, fraction double, seed int, n_train long, train_r2 double, train_rmse double, valid_r2 double, valid_rmse double"
FOLDS = "feature_set string, target string, seed int, fold int, n_valid long, r2 double, rmse double, mae double, bias double, pearson_r double"
SWEEP = "percent double, train_rows long, band string, r2 double, rmse double, mae double, bias double, pearson_r double"


def _columns(sets: dict[str, list[str]], targets: list[str]) -> tuple[list[str], dict[str, list[int]], dict[str, int]]:
    """All columns once, and where each set's features and each target stand in the matrices."""
    features = list(dict.fromkeys(c for s in sets.values() for c in s))
    at = {c: i + 1 for i, c in enumerate([*features, *targets])}
    return [*features, *targets], {k: [at[c] for c in s] for k, s in sets.items()}, {t: at[t] for t in targets}


def ridge_by_set(df: DataFrame, sets: dict[str, list[str]], targets: list[str], alpha: float = 1.0) -> dict[tuple[str, str], list[float]]:
    """(set, target) -> intercept and weights of the set's features, all models from one pass over the rows."""
    columns, features, target = _columns(sets, targets)
    (sums,) = gram_matrices(df.withColumn("_part", F.lit("all")), columns, ["_part"])
    if not sums:
        raise ValueError("no row has all features and targets")
    fits = {(name, t): (x, ridge_weights(sums["all"], x, y, alpha)) for name, x in features.items() for t, y in target.items()}
    return {k: [float(v) for v in w[[0, *x]]] for k, (x, w) in fits.items()}


def linear(x: Column, weights: list[float]) -> Column:
    """The prediction from an array of features and (intercept, weights)."""
    return F.lit(weights[0]) + dot(x, F.array(*map(F.lit, weights[1:])))


def learning_curve(df: DataFrame, key: str, strata: list[str], sets: dict[str, list[str]], targets: list[str], fractions: list[float], seeds: list[int], *, share: float = 0.3, split_seed: int = 42, alpha: float = 1.0) -> DataFrame:
    """Ridge on rising fractions of each stratum's training rows, scored on these rows and on a stratified holdout.

    A stratum gives round(share * n) test rows, and max(1, round(n * fraction)) of its other rows to a sample.
    """
    columns, features, target = _columns(sets, targets)
    split = nested_bins(df, strata, key, [F.bround(F.col("_n") * F.lit(share))], split_seed, "_train")
    train = split.filter("_train = 1")
    quota = lambda f: F.col("_n") if f >= 1 else F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(f)))
    fractions = sorted(fractions)
    for seed in seeds:
        train = nested_bins(train, strata, key, [quota(f) for f in fractions], seed, f"_bin_{seed}")
    bins = [f"_bin_{seed}" for seed in seeds]
    every = train.unionByName(split.filter("_train = 0"), allowMissingColumns=True).withColumn("_held", F.when(F.col("_train") == 0, "test"))
    *by_seed, held = gram_matrices(every, columns, [*bins, "_held"])
    empty = np.zeros((len(columns) + 1,) * 2)
    test = held.get("test", empty)
    rows = []
    for seed, found in zip(seeds, by_seed, strict=True):
        sums = empty
        for i, f in enumerate(fractions):
            sums = sums + found.get(str(i), empty)
            if sums[0, 0] == 0:
                continue
            for name, x in features.items():
                for t, y in target.items():
                    w = ridge_weights(sums, x, y, alpha)
                    fit, valid = metrics_of(sums, w, y), metrics_of(test, w, y)
                    rows.append((name, t, f, seed, fit["n"], fit["r2"], fit["rmse"], valid["r2"], valid["rmse"]))
    return df.sparkSession.createDataFrame(rows, CURVE)


def repeated_cv(df: DataFrame, folds: dict[int, str], sets: dict[str, list[str]], targets: list[str], alpha: float = 1.0) -> DataFrame:
    """Ridge scored on each fold and fitted on the others, for several splits (seed -> column of folds)."""
    columns, features, target = _columns(sets, targets)
    found = gram_matrices(df, columns, list(folds.values()))
    rows, cases = [], []
    for g, (seed, own) in enumerate(zip(folds, found, strict=True)):
        total = sum(own.values())
        for fold, m in sorted(own.items()):
            rest = total - m
            if rest[0, 0] < 1:
                continue
            for name, x in features.items():
                for t, y in target.items():
                    w = ridge_weights(rest, x, y, alpha)
                    cases.append(Case(g, fold, y, tuple(w)))
                    rows.append((name, t, seed, int(fold), metrics_of(m, w, y)))
    errors = absolute_errors(df, columns, list(folds.values()), cases)
    out = [(name, t, seed, fold, v["n"], v["r2"], v["rmse"], mae, v["bias"], v["pearson_r"]) for (name, t, seed, fold, v), mae in zip(rows, errors, strict=True)]
    return df.sparkSession.createDataFrame(out, FOLDS)


def sample_sweep(df: DataFrame, key: str, features: list[str], targets: list[str], percents: list[float], *, share: float = 0.2, seed: int = 42, alpha: float = 1.0) -> DataFrame:
    """Ridge on rising percentages of all rows, scored on a fixed validation set of round(share * n) rows, by target.

    A percentage of no rows gives each validation row the values of a row drawn from the pool.
    """
    columns, where, target = _columns({"all": features}, targets)
    n = df.count()
    held = round(share * n)
    percents = sorted(percents)
    sizes = [min(round(p / 100 * n), n - held) for p in percents]
    steps = sorted({s for s in sizes if s > 0})
    # Written once: matrices, errors and random draws read it, and its input may be a join.
    binned = durable(nested_bins(df.select(key, *columns), [], key, [F.lit(held), *[F.lit(held + s) for s in steps]], seed, "_bin"))
    (found,) = gram_matrices(binned, columns, ["_bin"])
    empty = np.zeros((len(columns) + 1,) * 2)
    valid, sums, weights = found.get("0", empty), empty, {}
    for i, s in enumerate(steps, 1):
        sums = sums + found.get(str(i), empty)
        weights[s] = {t: ridge_weights(sums, where["all"], y, alpha) for t, y in target.items()}
    cases = [(s, t) for s in steps for t in target]
    errors = dict(zip(cases, absolute_errors(binned.filter("_bin = 0"), columns, ["_bin"], [Case(0, "0", target[t], tuple(weights[s][t])) for s, t in cases]), strict=True))
    rows = []
    for p, s in zip(percents, sizes, strict=True):
        for t in target if s else ():
            v = metrics_of(valid, weights[s][t], target[t])
            rows.append((float(p), s, t, v["r2"], v["rmse"], errors[s, t], v["bias"], v["pearson_r"]))
    out = df.sparkSession.createDataFrame(rows, SWEEP)
    if none := [float(p) for p, s in zip(percents, sizes, strict=True) if s == 0]:
        drawn = random_draws(binned, key, targets, n - held, seed).withColumn("percent", F.explode(F.array(*map(F.lit, none))))
        out = out.unionByName(drawn.select("percent", F.lit(0).cast("long").alias("train_rows"), "band", "r2", "rmse", "mae", "bias", "pearson_r"))
    return out


def random_draws(binned: DataFrame, key: str, targets: list[str], pool: int, seed: int) -> DataFrame:
    """Metrics by band where each validation row (bin 0) is given the targets of a pool row drawn with replacement."""
    theirs = binned.filter("_bin > 0").select(F.col(key).alias("_k"), *[F.col(t).alias(f"_to_{t}") for t in targets]).withColumn("_u", hash01("_k", seed=seed))
    numbered = ranks_within(theirs, [], ["_u", "_k"], "_at")
    # The row's draw has decided its bin; another one picks its partner.
    picked = binned.filter("_bin = 0").withColumn("_at", F.floor(hash01(key, seed=seed + 1) * pool).cast("long") + 1)
    cells = [F.struct(F.lit(t).alias("band"), F.col(t).cast("double").alias("actual"), F.col(f"_to_{t}").cast("double").alias("predicted")) for t in targets]
    long = picked.join(numbered, "_at").select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return long.groupBy("band").agg(*regression_metrics(F.col("actual"), F.col("predicted")))


def linear_attribution(df: DataFrame, features: list[str], weights: dict[str, np.ndarray]) -> DataFrame:
    """(target, feature, mean_abs, mean_signed) of w (x - mean x) over the rows, for linear models given as (intercept, features, ...).

    A feature's mean deviation serves all targets, so the rows are spread once.
    """
    means = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f) - F.col(f"_m_{f}")).alias("c")) for f in features])).alias("x")
    spread = df.select(*features).crossJoin(F.broadcast(means)).select(cells).select("x.*").groupBy("feature").agg(F.avg(F.abs("c")).alias("mad"), F.avg("c").alias("shift"))
    table = df.sparkSession.createDataFrame([(t, f, float(w[i])) for t, w in weights.items() for i, f in enumerate(features, 1)], "target string, feature string, w double")
    return spread.join(table, "feature").select("target", "feature", (F.abs("w") * F.col("mad")).alias("mean_abs"), (F.col("w") * F.col("shift")).alias("mean_signed"))


def permutation_importance(df: DataFrame, key: str, features: list[str], targets: list[str], weights: dict[str, np.ndarray], repeats: int = 10, seed: int = 42) -> DataFrame:
    """(target, feature, mean_drop, std_drop): how much R² falls when a feature is shuffled, over ``repeats`` permutations of the rows.

    Weights are (intercept, features, ...) of linear models. A row meets its partner of each permutation once; what every
    feature's exchange does to the error follows from both rows in one matrix operation, so the
    number of jobs depends on neither features nor repeats. NULL where the target is constant.
    """
    whole = df.select(F.col(key).alias("_k"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"), F.array(*[F.col(t).cast("double") for t in targets]).alias("_y"))
    # Filtered after it is written: on columns of their own the optimiser would infer constraints without end.
    whole = durable(whole).filter(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)) & F.forall("_y", lambda v: v.isNotNull() & ~F.isnan(v)))
    partners = permuted(whole.select("_k", F.col("_k").alias("partner")), [], "_k", "partner", repeats, seed).select("_k", F.posexplode("partner").alias("repeat", "partner"))
    met = partners.join(whole, "_k").join(whole.select(F.col("_k").alias("partner"), F.col("_x").alias("_z")), "partner").select("repeat", "_x", "_z", "_y")
    w = np.array([weights[t][: len(features) + 1] for t in targets])
    held = df.sparkSession.sparkContext.broadcast(w)
    n_features, n_targets = len(features), len(targets)

    def run(batches):
        w = held.value
        total: dict[int, np.ndarray] = {}
        for b in batches:
            r = np.asarray(b.column(0))
            x, z, y = (np.asarray(b.column(i).flatten()).reshape(len(r), -1) for i in (1, 2, 3))
            error = w[:, 0] + x @ w[:, 1:].T - y
            for one in np.unique(r):
                own = r == one
                sums = np.zeros((n_targets, n_features + 4))
                for t in range(n_targets):
                    e, yt = error[own, t], y[own, t]
                    sums[t, :n_features] = ((e[:, None] + (z[own] - x[own]) * w[t, 1:]) ** 2).sum(0)
                    sums[t, n_features:] = (e @ e, yt @ yt, yt.sum(), len(yt))
                total[int(one)] = total.get(int(one), 0) + sums
        for one, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([one] * n_targets, pa.int32()), pa.array(range(n_targets), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["repeat", "target", "sums"])

    partial = met.mapInArrow(run, "repeat int, target int, sums array<double>").select("repeat", "target", F.posexplode("sums").alias("i", "v"))
    sums = {(r.repeat, r.target, r.i): r.v for r in partial.groupBy("repeat", "target", "i").agg(F.sum("v").alias("v")).toLocalIterator()}  # a bounded design
    rows = []
    for t, target in enumerate(targets):
        for f, feature in enumerate(features):
            drops = []
            for r in range(repeats if sums else 0):
                base, yy, ys, n = (sums[r, t, n_features + i] for i in range(4))
                spread = yy - ys * ys / n
                drops.append((sums[r, t, f] - base) / spread if spread > 1e-12 * max(yy, 1.0) else None)
            known = [x for x in drops if x is not None]
            rows.append((target, feature, float(np.mean(known)) if known else None, float(np.std(known)) if known else None))
    return df.sparkSession.createDataFrame(rows, "target string, feature string, mean_drop double, std_drop double")


def reconstruction(pixels: DataFrame, keys: list[str], features: list[str], targets: list[str], share: float, *, seed: int = 42, alpha: float = 1.0) -> DataFrame:
    """``pixels`` with ``is_train`` and, for every target, ``<target>_filled``: observed at sampled pixels, predicted by ridge elsewhere.

    All bands' models come from one pass over the sampled pixels, and predictions are plain expressions.
    """
    flagged = pixels.withColumn("is_train", hash01(*keys, seed=seed) < share)
    (sums,) = gram_matrices(flagged.filter("is_train").withColumn("_part", F.lit("train")), [*features, *targets], ["_part"])
    if not sums:
        raise ValueError("no pixel was sampled")
    at = list(range(1, len(features) + 1))
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    out = flagged.withColumn("_x", x)
    for i, t in enumerate(targets, 1):
        w = ridge_weights(sums["train"], at, len(features) + i, alpha)[: len(features) + 1]
        out = out.withColumn(f"{t}_filled", F.when(F.col("is_train"), F.col(t).cast("double")).otherwise(dot(F.col("_x"), F.array(*[F.lit(float(v)) for v in w]))))
    return out.drop("_x")
