"""Registration of queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 6):
    """Register a query; ``floats`` names the SQL columns to round like the Spark side."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = rounded_sql(sql, floats, digits)
        return fn

    return add


def rounded_sql(sql: str, floats: str, digits: int = 6) -> str:
    if not floats:
        return sql
    parts = ", ".join(f"round({c}::DOUBLE, {digits}) AS {c}" for c in floats.split())
    return f"SELECT * REPLACE ({parts}) FROM ({sql}) AS _q"


def u(key: str, tag: str) -> str:
    """The deterministic uniform in SQL."""
    return f"(('0x'||substr(md5({key}||'-{tag}'),1,8))::BIGINT/4294967296.0)"


_ROWS = """FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def scored_sql(tag: str = "a", lift: float = 0.35) -> str:
    y = "(o_orderstatus='F')::INTEGER"
    score = f"floor(({lift}::DOUBLE*{y} + {1.0 - lift}::DOUBLE*{u('o_orderkey', tag)})*100.0::DOUBLE+0.5::DOUBLE)/100.0::DOUBLE"
    return f"""SELECT row_id, y_true, y_score, (y_score >= 0.5::DOUBLE)::INTEGER AS y_pred, gender, city, age, family_history
      FROM (SELECT o_orderkey AS row_id, {y} AS y_true, {score} AS y_score, c_mktsegment AS gender, n_name AS city,
                   (18 + o_custkey % 17)::INTEGER AS age,
                   CASE WHEN o_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS family_history {_ROWS})"""


SCORED = f"scored AS MATERIALIZED ({scored_sql()})"
SCORED2 = f"scored2 AS MATERIALIZED ({scored_sql('b', 0.25)})"
MODELS = f"""{SCORED}, {SCORED2}, models AS (
  SELECT 'first' AS model, row_id, y_true, y_score, y_pred FROM scored
  UNION ALL SELECT 'second', row_id, y_true, y_score, y_pred FROM scored2)"""
SURVEY = f"""survey AS MATERIALIZED (
  SELECT o_orderkey AS id, (18 + o_custkey % 17)::INTEGER AS age, c_acctbal AS balance, o_totalprice AS price,
         nullif(o_custkey % 6, 5)::INTEGER AS pressure, c_mktsegment AS gender, o_orderpriority AS priority,
         n_name AS city, CASE WHEN o_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS family_history,
         CASE WHEN {u('o_orderkey', 's')} < 0.6::DOUBLE + 0.3::DOUBLE*(o_orderstatus='F')::INTEGER THEN 'Yes' ELSE 'No' END AS sensitive,
         (o_orderstatus='F')::INTEGER AS target {_ROWS})"""
AGE_BAND = """CASE WHEN age BETWEEN 18 AND 22 THEN '18-22' WHEN age BETWEEN 23 AND 26 THEN '23-26'
  WHEN age BETWEEN 27 AND 30 THEN '27-30' WHEN age BETWEEN 31 AND 120 THEN '31+' END"""
FAMILIES = f"""families AS (
  SELECT 'gender' AS family, gender AS label, y_true, y_score, y_pred FROM scored
  UNION ALL SELECT 'age', {AGE_BAND}, y_true, y_score, y_pred FROM scored
  UNION ALL SELECT 'family_history', family_history, y_true, y_score, y_pred FROM scored
  UNION ALL SELECT 'city', city, y_true, y_score, y_pred FROM scored)"""


def metrics_sql(source: str, by: str) -> str:
    """Every scalar metric per group, straight from its definition."""
    part = f"PARTITION BY {by}" if by else ""
    comma = f"{by}," if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {comma} count(*) AS n_samples, sum(y_true)::BIGINT AS n_positive, sum(1-y_true)::BIGINT AS n_negative,
      avg(y_true) AS prevalence, avg(y_pred) AS positive_rate,
      CASE WHEN sum(y_true) > 0 AND sum(1-y_true) > 0
        THEN (sum(y_true*mid) - sum(y_true)*(sum(y_true)+1)/2.0)/(sum(y_true)*sum(1-y_true)) END AS roc_auc,
      CASE WHEN sum(y_true) > 0 AND sum(1-y_true) > 0 THEN sum(y_true*hit/seen)/sum(y_true) END AS pr_auc,
      avg((y_true-y_score)*(y_true-y_score)) AS brier_score,
      avg((y_true=y_pred)::INTEGER) AS accuracy,
      coalesce(sum(y_true*y_pred)/nullif(sum(y_pred),0),0) AS precision,
      coalesce(sum(y_true*y_pred)/nullif(sum(y_true),0),0) AS recall,
      coalesce(sum((1-y_true)*(1-y_pred))/nullif(sum(1-y_true),0),0) AS specificity,
      coalesce(2.0*sum(y_true*y_pred)/nullif(sum(y_pred)+sum(y_true),0),0) AS f1,
      coalesce(sum((1-y_true)*y_pred)/nullif(sum(1-y_true),0),0) AS fpr,
      coalesce(sum(y_true*(1-y_pred))/nullif(sum(y_true),0),0) AS fnr,
      coalesce(sum((1-y_true)*(1-y_pred))/nullif(sum(1-y_pred),0),0) AS npv,
      sum(y_true*y_pred)::BIGINT AS tp, sum((1-y_true)*y_pred)::BIGINT AS fp,
      sum(y_true*(1-y_pred))::BIGINT AS fn, sum((1-y_true)*(1-y_pred))::BIGINT AS tn
    FROM (SELECT *, rank() OVER lowhigh + (count(*) OVER (PARTITION BY {comma} y_score) - 1)/2.0 AS mid,
            sum(y_true) OVER highlow AS hit, count(*) OVER highlow AS seen
          FROM {source}
          WINDOW lowhigh AS ({part} ORDER BY y_score), highlow AS ({part} ORDER BY y_score DESC RANGE UNBOUNDED PRECEDING))
    {group}"""


METRIC_FLOATS = "prevalence positive_rate roc_auc pr_auc brier_score accuracy precision recall specificity f1 fpr fnr npv"
