"""Cases at the edges: scores far below one, rows without a class, line-wise JSON, very many levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import METRIC_FLOATS, SCORED, SURVEY, metrics_sql, query, u
from cohort import fixtures
from cohort.functions.columns import rounded
from cohort.functions.hashing import uniform
from cohort.operators import clean, evaluate, profile, split
from cohort.plans.deploy import read_records
from cohort.sources.tables import scratch_path, write_json

_FINE = f"WITH {SCORED}, fine AS (SELECT * REPLACE ((y_score + {u('row_id', 'fine')}/1000.0::DOUBLE)*1e-9::DOUBLE AS y_score) FROM scored)"


def _fine(spark, sf):
    """Scores of a rare event: all below 1e-8, hardly any two alike."""
    score = (F.col("y_score") + uniform("row_id", "fine") / F.lit(1000.0)) * F.lit(1e-9)
    return fixtures.scored(spark, sf).withColumn("y_score", score)


@query("fine_score_metrics", f"{_FINE} {metrics_sql('fine', '')}", METRIC_FLOATS)
def _(spark, sf):
    return rounded(evaluate.binary_metrics(_fine(spark, sf)))


@query("fine_score_metrics_by_group", f"{_FINE} {metrics_sql('fine', 'city')}", METRIC_FLOATS)
def _(spark, sf):
    return rounded(evaluate.binary_metrics(_fine(spark, sf), ["city"]))


@query("folds_with_missing_class", f"WITH {SURVEY} SELECT id, ((row_number() OVER (PARTITION BY pressure ORDER BY {u('id', 'fold')}, id) - 1) % 4)::INTEGER AS fold FROM survey")
def _(spark, sf):
    return split.stratified_folds(fixtures.survey(spark, sf), "id", "pressure", 4).select("id", "fold")


@query("undersample_with_missing_class", f"""WITH {SURVEY}, r AS (SELECT id, pressure, row_number() OVER (PARTITION BY pressure ORDER BY {u('id', 'under')}, id) AS r FROM survey)
   SELECT id, pressure::VARCHAR AS pressure FROM r WHERE pressure IS NULL OR r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM survey WHERE pressure IS NOT NULL GROUP BY pressure))""")
def _(spark, sf):
    return split.undersample(fixtures.survey(spark, sf), "id", "pressure").select("id", F.col("pressure").cast("string").alias("pressure"))


@query("json_lines_input", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders", "o_totalprice")
def _(spark, sf):
    path = scratch_path(spark, "orders.json")
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
    write_json(fixtures.table(spark, sf, "orders").select(*columns), path)
    return rounded(read_records(spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string").select(*columns))


@query("one_hot_sparse", """WITH l AS (SELECT 'o_clerkish' AS "column", v AS level, (row_number() OVER (ORDER BY v) - 1)::BIGINT AS position FROM (SELECT DISTINCT 'c'||(o_orderkey % 20000) AS v FROM orders)
     UNION ALL SELECT 'o_orderpriority', v, (SELECT count(DISTINCT o_orderkey % 20000) FROM orders) + row_number() OVER (ORDER BY v) - 1 FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))
   SELECT o_orderkey, l."column", level, position FROM orders JOIN l ON (l."column"='o_clerkish' AND level='c'||(o_orderkey % 20000)) OR (l."column"='o_orderpriority' AND level=o_orderpriority)""")
def _(spark, sf):
    orders = fixtures.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_orderkey") % 20000).alias("o_clerkish"), "o_orderpriority")
    return clean.one_hot_sparse(orders, "o_orderkey", ["o_clerkish", "o_orderpriority"])


@query("first_and_last", "SELECT o_orderstatus, arg_min(o_totalprice, o_orderkey) AS o_totalprice_first, arg_max(o_totalprice, o_orderkey) AS o_totalprice_last FROM orders GROUP BY 1", "o_totalprice_first o_totalprice_last")
def _(spark, sf):
    orders = fixtures.table(spark, sf, "orders")
    return rounded(profile.aggregate_by_group(orders, "o_orderstatus", metrics={"first": ("o_totalprice", "o_orderkey"), "last": ("o_totalprice", "o_orderkey")}))
