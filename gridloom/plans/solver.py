"""Ridge in SQL: sums of products, Gauss-Jordan elimination as a recursive query, and predictions.

A query gives the steps ``vec`` (id, v), a list of 1, the features and the targets, and ``member`` (c, id), the
training rows of each case; it gets ``weights`` (c, s, t, b, w): intercept and weights of target t in case c on feature set s.
"""

from __future__ import annotations

from gridloom.operators import projections as p
from gridloom.sources import tables

FEATURES = [f"A{i:02d}" for i in range(64)]
CONTEXT = [*FEATURES, *tables.LABELS, *[f"region_{r}" for r in tables.REGIONS]]
SETS = {"embedding_only": FEATURES, "embedding_plus_context": CONTEXT}


def study_rows(spark, d):
    """Samples with all features of both sets and the targets as columns."""
    return p.one_hot(p.spread_embedding(tables.samples(spark, d)), "region", list(tables.REGIONS))


_TARGETS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(tables.TARGETS, 1))
_FLAGS = ", ".join(f"CAST(region = '{r}' AS DOUBLE)" for r in tables.REGIONS)
STUDY_STEPS = {
    "vec": f"SELECT sample_id AS id, [1.0::DOUBLE] || list_transform(embedding, lambda x: CAST(x AS DOUBLE)) || [{', '.join(tables.LABELS)}, {_FLAGS}] || [{', '.join(tables.TARGETS)}] AS v FROM samples",
    "targets": f"SELECT * FROM (VALUES {_TARGETS}) x(t, target)",
}
STUDY_SETS = {k: len(v) for k, v in SETS.items()}
recursive = lambda sql: "WITH RECURSIVE" + sql.removeprefix("WITH")


def ridge_steps(sets: dict[str, int], features: int, targets: int = 3, alpha: float = 1.0) -> dict[str, str]:
    """``sets``: name -> how many of the first features it has."""
    width, first = 1 + features + targets, 2 + features
    named = ", ".join(f"('{k}', {v})" for k, v in sets.items())
    eliminate = "CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / top[k + 1]) ELSE list_transform(r, lambda x, n: x - r[k + 1] / top[k + 1] * top[n]) END"
    return {
        "gram": f"SELECT c, i, j, sum(v[i] * v[j]) AS g FROM member JOIN vec USING (id), (SELECT unnest(range(1, {width + 1})) AS i), (SELECT unnest(range(1, {width + 1})) AS j) GROUP BY c, i, j",
        "means": "SELECT c, list(g ORDER BY j) AS m FROM gram WHERE i = 1 GROUP BY c",
        "sets": f"SELECT * FROM (VALUES {named}) x(s, p)",
        "system": f"SELECT c, s, p, i - 1 AS i, list(g - m[i] * m[j] / m[1] + CASE WHEN i = j THEN CAST({alpha} AS DOUBLE) ELSE 0 END ORDER BY j) AS r FROM gram JOIN means USING (c), sets WHERE i BETWEEN 2 AND p + 1 AND (j BETWEEN 2 AND p + 1 OR j >= {first}) GROUP BY c, s, p, i",
        "solved": f"SELECT c, s, p, 0 AS k, i, r FROM system UNION ALL SELECT c, s, p, k + 1, i, {eliminate} FROM (SELECT *, first_value(r) OVER (PARTITION BY c, s ORDER BY i <> k + 1) AS top FROM solved WHERE k < p)",
        "raw": f"SELECT c, s, p, t, list(r[p + t] ORDER BY i) AS w FROM solved, (SELECT unnest(range(1, {targets + 1})) AS t) WHERE k = p GROUP BY c, s, p, t",
        "weights": f"SELECT c, s, t, w, (m[{first - 1} + t] - list_inner_product(w, m[2:p + 1])) / m[1] AS b FROM raw JOIN means USING (c)",
    }


#: A prediction from ``v`` and a row of ``weights``.
PREDICTION = "b + list_inner_product(w, v[2:len(w) + 1])"


def fit_metrics(actual: str = "a", predicted: str = "q") -> dict[str, str]:
    """Aggregates of actual and predicted values by name."""
    e = f"({predicted} - {actual})"
    return {
        "r2": f"1 - sum({e} * {e}) / nullif(var_pop({actual}) * count(*), 0)",
        "rmse": f"sqrt(avg({e} * {e}))",
        "mae": f"avg(abs({e}))",
        "bias": f"avg({e})",
        "pearson_r": f"covar_pop({predicted}, {actual}) / nullif(sqrt(var_pop({predicted}) * var_pop({actual})), 0)",
    }


def selected(*names: str, prefix: str = "", digits: int = 6) -> str:
    found = fit_metrics()
    return ", ".join(f"round({found[n]}, {digits}) AS {prefix}{n}" for n in names)
