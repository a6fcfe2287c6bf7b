"""Registry of queries: each has a name, a Spark function of (spark, sf_dir), and SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources.tables import LABELS, REGIONS

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def e(i: int) -> str:
    return f"CAST(embedding[{i}] AS DOUBLE)"


_VV, _VH = f"-13 + 12 * {e(1)} + 6 * {e(2)}", f"-20 + 10 * {e(1)} - 8 * {e(3)}"
_names = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]"
#: The views of ``sources.tables`` in SQL.
VIEWS = {
    "samples": f"""SELECT vec_id AS sample_id, CAST(label % 9 AS INTEGER) AS dw_label, ({_names(LABELS)})[label % 9 + 1] AS dw_label_name, ({_names(REGIONS)})[vec_id % 4 + 1] AS region,
      {_VV} AS S1_VV, {_VH} AS S1_VH, ({_VV}) - ({_VH}) AS S1_VV_div_VH, 37 + {e(5)} AS latitude, -122 + {e(6)} AS longitude, {", ".join(f"abs({e(20 + i)}) AS {n}" for i, n in enumerate(LABELS))}, embedding FROM embeddings""",
    "pixels": """SELECT 't0' AS tile, o_orderkey // 128 AS image_row, o_orderkey % 128 AS image_col, CASE WHEN o_orderstatus <> 'P' THEN -25 + o_totalprice / 20000 END AS S1_VV,
      -30 + o_totalprice / 25000 AS S1_VH, o_orderkey AS pixel_id, CASE WHEN o_orderstatus <> 'P' THEN -25 + o_totalprice / 20000 END - (-30 + o_totalprice / 25000) AS S1_VV_div_VH FROM orders""",
    "predictions": """SELECT l_returnflag AS region, l_linestatus AS dw_label_name, l_linenumber AS fold, l_orderkey AS sample_id, l_extendedprice / 1000 AS actual, l_quantity * CAST(2.1 AS DOUBLE) AS predicted,
      l_quantity * CAST(2.1 AS DOUBLE) - l_extendedprice / 1000 AS residual FROM lineitem""",
    "scenes": """SELECT event_id AS scene_id, ts, user_id AS pixel_id, event_type AS dw_label_name, value AS band, value / 2 - 3 AS VH, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
      CAST(json_extract_string(props, '$.k') AS INTEGER) * 64 AS qa60, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cloudy_pct, CAST(event_id % 360 - 180 AS DOUBLE) AS lon, CAST(user_id % 90 AS DOUBLE) AS lat,
      CASE WHEN event_id % 3 = 0 THEN 'IW' ELSE 'EW' END AS instrument_mode, CASE WHEN event_id % 2 = 0 THEN 10 ELSE 25 END AS resolution_m,
      CASE WHEN event_id % 5 = 0 THEN ['VV'] WHEN event_id % 5 = 1 THEN ['VH', 'VV'] ELSE ['VV', 'VH'] END AS polarisations FROM events""",
}


def over(views: str, select: str, **more: str) -> str:
    """SQL over some views and further named steps."""
    steps = {v: VIEWS[v] for v in views.split()} | more
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in steps.items()) + "\n" + select


def round_sql(sql: str, keys: str, values: str, digits: int = 6) -> str:
    """``sql`` with the given value columns rounded."""
    columns = [*keys.split(), *[f"round({v}, {digits}) AS {v}" for v in values.split()]]
    return f"SELECT {', '.join(columns)} FROM ({sql})"


def draw(*keys: str, seed: int) -> str:
    """``functions.stats.hash01`` in SQL."""
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, '{seed}')), 1, 8)) AS BIGINT)::DOUBLE / 4294967296)"


def pair_steps(source: str, key: str, m: int, seed: int, group: str = "'all'", turns: int = 6) -> dict[str, str]:
    """``operators.sampling.pair_draw`` in SQL: the step ``pairs`` (g, a, b)."""
    steps = {
        "numbered": f"SELECT {group} AS g, {key} AS k, row_number() OVER (PARTITION BY {group} ORDER BY {key}) - 1 AS at, count(*) OVER (PARTITION BY {group}) AS n FROM {source}",
        "tournament": "SELECT g, n, CASE WHEN n % 2 = 1 THEN n ELSE n // 2 END AS x, CASE WHEN n % 2 = 1 THEN (n - 1) // 2 ELSE n - 1 END AS y FROM (SELECT DISTINCT g, n FROM numbered WHERE n > 1)",
        "turn0": f"SELECT *, j % x AS l, j // x AS r FROM (SELECT *, unnest(range(0, least({m}, x * y))) AS j FROM tournament)",
    }
    for t in range(turns):
        to, by, of = ("l", "r", "x") if t % 2 == 0 else ("r", "l", "y")
        steps[f"turn{t + 1}"] = f"SELECT * REPLACE (({to} + CAST(floor({draw(by, str(t), seed=seed)} * {of}) AS BIGINT)) % {of} AS {to}) FROM turn{t}"
    one = "CASE WHEN n % 2 = 1 THEN l WHEN l = 0 THEN n - 1 ELSE (r + l) % (n - 1) END"
    two = "CASE WHEN n % 2 = 1 THEN (l + r + 1) % n WHEN l = 0 THEN r ELSE (r - l + n - 1) % (n - 1) END"
    steps["drawn"] = f"SELECT g, least({one}, {two}) AS x, greatest({one}, {two}) AS y FROM turn{turns}"
    steps["pairs"] = "SELECT d.g, p.k AS a, q.k AS b FROM drawn d JOIN numbered p ON p.g = d.g AND p.at = d.x JOIN numbered q ON q.g = d.g AND q.at = d.y"
    return steps


def p_value_sql(r: str, n: str) -> str:
    """The two-sided p-value of a correlation as the finite sum that it is for whole degrees of freedom."""
    even = f"1 - abs({r}) * list_sum(list_transform(range(0, ({n} - 2) // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * pow(1 - {r} * {r}, k)))"
    odd = f"1 - 2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * coalesce(list_sum(list_transform(range(0, ({n} - 3) // 2), lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(1 - {r} * {r}, k))), 0))"
    return f"CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0 WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END"


#: Aggregates of ``functions.stats.regression_metrics`` in SQL.
METRICS = """count(predicted - actual) AS n, 1 - sum((predicted - actual) * (predicted - actual)) / nullif(var_pop(actual) * count(predicted - actual), 0) AS r2,
  sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse, avg(abs(predicted - actual)) AS mae, avg(predicted - actual) AS bias, covar_pop(predicted, actual) / nullif(sqrt(var_pop(actual) * var_pop(predicted)), 0) AS pearson_r"""
METRIC_COLUMNS = "r2 rmse mae bias pearson_r"
