"""Column transforms, filters, joins and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import AGE_BAND, SCORED, SURVEY, query
from cohort import fixtures
from cohort.functions.columns import column, melt, rounded
from cohort.operators import charts, clean, profile, rank
from cohort.roles import ColumnRoles

ROLES = ColumnRoles(
    target="target", row_id="id", numeric=["age", "balance", "price"], ordinal=["pressure"],
    nominal=["gender", "priority", "city", "family_history"], sensitive="sensitive", excluded=["city"],
)
S = f"WITH {SURVEY}"
SURVEY_COLUMNS = "id age balance price pressure gender priority city family_history sensitive target".split()


@query("normalize_names", "SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_quantity AS qty, l_returnflag AS flag_a FROM lineitem", "qty")
def _(spark, sf):
    raw = fixtures.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias(" Order Key "), F.col("l_linenumber").alias("LINE-NO"),
        F.col("l_quantity").alias("Qty"), F.col("l_returnflag").alias("Flag A"))
    return clean.normalize_names(raw)


@query("rename_and_recode", """SELECT c_custkey AS "id", CASE c_mktsegment WHEN 'BUILDING' THEN 'built' WHEN 'MACHINERY' THEN 'machines' ELSE c_mktsegment END AS segment,
   c_acctbal FROM customer""")
def _(spark, sf):
    df = fixtures.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    renamed = clean.rename_columns(df, {"c_custkey": "id", "c_mktsegment": "segment", "absent": "x"})
    return clean.recode_values(renamed, {"segment": {"BUILDING": "built", "MACHINERY": "machines"}})


@query("column_roles", f"""{S}, n AS (SELECT 'gender' AS "column", count(DISTINCT gender) + max((gender IS NULL)::INT) AS levels FROM survey
   UNION ALL SELECT 'priority', count(DISTINCT priority) + max((priority IS NULL)::INT) FROM survey
   UNION ALL SELECT 'city', count(DISTINCT city) + max((city IS NULL)::INT) FROM survey
   UNION ALL SELECT 'family_history', count(DISTINCT family_history) FROM survey UNION ALL SELECT 'sensitive', count(DISTINCT sensitive) FROM survey)
  SELECT "column", 'nominal' AS role, levels::BIGINT AS levels, (levels-1)::BIGINT AS n_features FROM n
  UNION ALL SELECT c, 'numeric', 0, 1 FROM (VALUES ('age'),('balance'),('price')) v(c)
  UNION ALL SELECT 'pressure', 'ordinal', 0, 1 UNION ALL SELECT 'id', 'id', 0, 0 UNION ALL SELECT 'target', 'target', 0, 0""")
def _(spark, sf):
    return clean.column_roles(fixtures.survey(spark, sf), ROLES).fillna(0, ["levels"])


@query("standardize_report", f"""{S} SELECT CASE WHEN gender='BUILDING' THEN 'B' ELSE gender END AS sex, CASE sensitive WHEN 'Yes' THEN 'Co' WHEN 'No' THEN 'Khong' END AS flag,
   count(*) AS n FROM survey GROUP BY ALL""")
def _(spark, sf):
    table, _report = clean.standardize(
        fixtures.survey(spark, sf), {"gender": "sex", "sensitive": "flag"},
        {"sex": {"BUILDING": "B"}, "flag": {"Yes": "Co", "No": "Khong"}}, ROLES)
    return table.groupBy("sex", "flag").agg(F.count(F.lit(1)).alias("n"))


@query("clean_table", """SELECT event_id, user_id, event_type, coalesce(nullif(value, 0), (SELECT median(nullif(value,0)) FROM events)) AS value
   FROM events WHERE nullif(event_type, 'error') IS NOT NULL""", "value")
def _(spark, sf):
    raw = fixtures.table(spark, sf, "events").select(
        F.col("event_id").alias("Event ID"), F.col("user_id").alias("User-ID"),
        F.nullif(F.col("event_type"), F.lit("error")).alias("Event Type"), F.nullif(F.col("value"), F.lit(0.0)).alias(" Value"))
    return rounded(clean.clean(raw, ["event_type", "value", "absent"]))


@query("select_profile", f"{S} SELECT id, age, balance, price, coalesce(pressure, -1) AS pressure, gender, priority, city, family_history, target FROM survey")
def _(spark, sf):
    return clean.select_profile(fixtures.survey(spark, sf), ROLES, "safe").fillna(-1, ["pressure"])


@query("drop_excluded", f"{S} SELECT age, gender, sensitive, target, count(*) AS n FROM survey GROUP BY ALL")
def _(spark, sf):
    kept = clean.drop_excluded(fixtures.survey(spark, sf), ["id", "city", "balance", "price", "pressure", "priority", "family_history"])
    return kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("n"))


@query("severity_bands", """SELECT category, count(*) AS n FROM (SELECT CASE WHEN s <= 4 THEN 'Không trầm cảm' WHEN s <= 9 THEN 'Nhẹ' WHEN s <= 14 THEN 'Trung bình' WHEN s <= 19 THEN 'Khá nặng' ELSE 'Nặng' END AS category
   FROM (SELECT nullif(l_quantity::INT, 50) AS s FROM lineitem)) GROUP BY category""")
def _(spark, sf):
    df = fixtures.table(spark, sf, "lineitem").select(F.nullif(F.col("l_quantity").cast("int"), F.lit(50)).alias("s"))
    return df.groupBy(clean.severity("s").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("binary_target", "SELECT l_orderkey, l_linenumber, (l_quantity >= 16)::INTEGER AS target FROM lineitem")
def _(spark, sf):
    df = fixtures.table(spark, sf, "lineitem")
    return df.select("l_orderkey", "l_linenumber", clean.binary_target(df, "l_quantity").alias("target"))


@query("coerce_types", "SELECT event_id::DOUBLE AS event_id, event_type, TRY_CAST(props->>'k' AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS junk FROM events")
def _(spark, sf):
    df = fixtures.table(spark, sf, "events").select(
        "event_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("junk"))
    return clean.coerce_types(df, ["event_id", "k", "junk"])


@query("age_bands", f"""{S} SELECT {AGE_BAND} AS band, count(*) AS n FROM survey GROUP BY 1""")
def _(spark, sf):
    return fixtures.survey(spark, sf).groupBy(clean.band("age").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("median_imputation", f"{S} SELECT id, coalesce(pressure, (SELECT quantile_cont(pressure, 0.5) FROM survey))::DOUBLE AS pressure, price FROM survey")
def _(spark, sf):
    return clean.fill_medians(fixtures.survey(spark, sf).select("id", "pressure", "price"), ["pressure"])


@query("mode_imputation", """WITH e AS (SELECT event_id, nullif(event_type,'click') AS event_type, NULL::VARCHAR AS empty FROM events),
   m AS (SELECT event_type FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
   SELECT event_id, coalesce(event_type, (SELECT event_type FROM m)) AS event_type, 'Missing' AS empty FROM e""")
def _(spark, sf):
    df = fixtures.table(spark, sf, "events").select(
        "event_id", F.nullif(F.col("event_type"), F.lit("click")).alias("event_type"), F.lit(None).cast("string").alias("empty"))
    return clean.fill_modes(df)


@query("fit_transform_fills", f"""{S}, train AS (SELECT * FROM survey WHERE family_history='No')
   SELECT id, coalesce(pressure, (SELECT quantile_cont(pressure,0.5) FROM train))::DOUBLE AS pressure,
     coalesce(nullif(gender,'BUILDING'), (SELECT nullif(gender,'BUILDING') AS g FROM train WHERE nullif(gender,'BUILDING') IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, g LIMIT 1)) AS gender
   FROM survey WHERE family_history='Yes'""")
def _(spark, sf):
    df = fixtures.survey(spark, sf).withColumn("gender", F.nullif(F.col("gender"), F.lit("BUILDING")))
    fills = clean.learn_fills(df.filter("family_history = 'No'"), numeric=["pressure"], text=["gender"])
    return fills.transform(df.filter("family_history = 'Yes'")).select("id", "pressure", "gender")


@query("zscore", """SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ())/stddev_pop(l_quantity) OVER () AS l_quantity,
   (l_tax - avg(l_tax) OVER ())/stddev_pop(l_tax) OVER () AS l_tax, 0.0::DOUBLE AS flat FROM lineitem""", "l_quantity l_tax")
def _(spark, sf):
    df = fixtures.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.lit(3.0).alias("flat"))
    return rounded(clean.zscore(df, ["l_quantity", "l_tax", "flat"]))


@query("level_index", f"""{S} SELECT 'city' AS "column", city AS value, (row_number() OVER (ORDER BY city) - 1)::INTEGER AS index FROM (SELECT DISTINCT city FROM survey)
   UNION ALL SELECT 'priority', priority, (row_number() OVER (ORDER BY priority) - 1)::INTEGER FROM (SELECT DISTINCT priority FROM survey)
   UNION ALL SELECT 'age', age::VARCHAR, (row_number() OVER (ORDER BY age) - 1)::INTEGER FROM (SELECT DISTINCT age FROM survey)""")
def _(spark, sf):
    return clean.level_index(fixtures.survey(spark, sf), ["city", "priority", "age"])


@query("label_encoding", """SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::INTEGER AS c_name_index,
   CASE WHEN nullif(c_mktsegment,'BUILDING') IS NOT NULL THEN (dense_rank() OVER (ORDER BY nullif(c_mktsegment,'BUILDING') NULLS LAST) - 1)::INTEGER ELSE -1 END AS segment_index FROM customer""")
def _(spark, sf):
    df = fixtures.table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    return clean.encode_levels(df, ["c_name", "segment"]).select("c_custkey", "c_name_index", "segment_index").fillna(-1)


@query("one_hot", f"""{S} SELECT id, (priority='1-URGENT')::INTEGER AS "priority_1-URGENT", (priority='2-HIGH')::INTEGER AS "priority_2-HIGH", (priority='3-MEDIUM')::INTEGER AS "priority_3-MEDIUM",
   (priority='4-NOT SPECIFIED')::INTEGER AS "priority_4-NOT SPECIFIED", (priority='5-LOW')::INTEGER AS "priority_5-LOW" FROM survey""")
def _(spark, sf):
    return clean.one_hot(fixtures.survey(spark, sf).select("id", "priority"), ["priority"])


@query("one_hot_unseen", f"""{S} SELECT id, (priority='1-URGENT')::INTEGER AS "priority_1-URGENT", (priority='2-HIGH')::INTEGER AS "priority_2-HIGH" FROM survey""")
def _(spark, sf):
    df = fixtures.survey(spark, sf).select("id", "priority")
    learnt = clean.column_levels(df.filter(F.col("priority") < "3"), ["priority"])
    return clean.one_hot(df, ["priority"], learnt)


@query("binary_codes", f"{S} SELECT id, (family_history='Yes')::INTEGER AS family_history, (sensitive='Yes')::INTEGER AS sensitive FROM survey")
def _(spark, sf):
    return clean.binary_codes(fixtures.survey(spark, sf).select("id", "family_history", "sensitive", "priority"), ["family_history", "sensitive", "priority"])


@query("at_risk_filter", "SELECT * FROM lineitem WHERE l_quantity >= 16")
def _(spark, sf):
    return clean.at_risk(fixtures.table(spark, sf, "lineitem"), score="l_quantity")


@query("demographic_filter", f"{S} SELECT id, age, gender, priority FROM survey WHERE lower(gender)='building' AND age BETWEEN 20 AND 28 AND lower(priority)='5-low'")
def _(spark, sf):
    df = fixtures.survey(spark, sf).select("id", "age", "gender", "priority")
    return clean.by_demographics(df, "Building", 20, 28, "5-low", {"education": "priority"})


@query("lazy_pipeline", """SELECT category, count(*) AS n, avg(value) AS mean_value FROM (SELECT CASE WHEN value <= 4 THEN 'Không trầm cảm' WHEN value <= 9 THEN 'Nhẹ'
   WHEN value <= 14 THEN 'Trung bình' WHEN value <= 19 THEN 'Khá nặng' ELSE 'Nặng' END AS category, value FROM events WHERE value >= 2) GROUP BY category""", "mean_value")
def _(spark, sf):
    out = clean.pipeline(
        fixtures.table(spark, sf, "events"), lambda t: clean.at_risk(t, 2, "value"),
        lambda t: t.withColumn("category", clean.severity("value")),
        lambda t: t.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))
    return rounded(out)


@query("drop_missing", f"{S} SELECT id, pressure, gender FROM survey WHERE pressure IS NOT NULL")
def _(spark, sf):
    return clean.drop_missing(fixtures.survey(spark, sf).select("id", "pressure", "gender"), ["pressure", "absent"])


@query("min_group_size", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 60")
def _(spark, sf):
    counts = fixtures.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return clean.min_group_size(counts, 60)


@query("dictionary_lookup", """SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey""")
def _(spark, sf):
    nations = fixtures.table(spark, sf, "nation").filter("n_regionkey < 3")
    out = clean.lookup(fixtures.table(spark, sf, "supplier"), "s_nationkey", nations, "n_nationkey", "n_name", "unknown", "nation")
    return out.select("s_suppkey", "nation")


# ---------------------------------------------------------------- aggregates

@query("aggregate_by_group", """SELECT event_type, avg(value) AS value_mean, stddev_samp(value) AS value_std, quantile_cont(value,0.5) AS value_median,
   count(value) AS value_count, min(value) AS value_min, max(value) AS value_max FROM events GROUP BY 1""", "value_mean value_std value_median value_min value_max")
def _(spark, sf):
    return rounded(profile.aggregate_by_group(fixtures.table(spark, sf, "events"), "event_type", "value"))


@query("aggregate_custom_metrics", """SELECT l_returnflag, sum(l_tax) AS l_tax_sum, max(l_quantity) AS l_quantity_max, avg(l_extendedprice*(1-l_discount)) AS net FROM lineitem GROUP BY 1""", "l_tax_sum net", 4)
def _(spark, sf):
    net = F.avg(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")))
    return rounded(profile.aggregate_by_group(
        fixtures.table(spark, sf, "lineitem"), "l_returnflag",
        metrics={"sum": "l_tax", "max": "l_quantity", "net": net, "unheard_of": "l_tax"}), 4)


def _each(names, expr, source="survey"):
    return " UNION ALL ".join(f"""SELECT '{n}' AS "column", {expr.replace('$', n)} FROM {source}""" for n in names)


@query("describe_columns", f"""{S} {_each(['age','balance','price','pressure'], "count($) AS count, count(*) - count($) AS null_count, avg($) AS mean, stddev_samp($) AS std, min($)::DOUBLE AS min, max($)::DOUBLE AS max, quantile_cont($,0.25)::DOUBLE AS q25, quantile_cont($,0.5)::DOUBLE AS q50, quantile_cont($,0.75)::DOUBLE AS q75")}""",
       "mean std min max q25 q50 q75", 4)
def _(spark, sf):
    return rounded(profile.describe(fixtures.survey(spark, sf), ["age", "balance", "price", "pressure"]), 4)


_STATS = "count($) AS n, count(*) - count($) AS missing, avg($) AS mean, stddev_samp($) AS std, min($)::DOUBLE AS min, max($)::DOUBLE AS max, avg(($-m)^3)/pow(avg(($-m)^2),1.5) AS skew, avg(($-m)^4)/pow(avg(($-m)^2),2) - 3 AS kurtosis, quantile_cont($,0.25) AS q25, quantile_cont($,0.5) AS median, quantile_cont($,0.75) AS q75"


@query("descriptive_stats", " UNION ALL ".join(f"""SELECT '{c}' AS "column", {_STATS.replace('$', c)} FROM (SELECT *, avg({c}) OVER () AS m FROM lineitem)""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
       "mean std min max skew kurtosis q25 median q75", 4)
def _(spark, sf):
    return rounded(profile.descriptive_stats(fixtures.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


@query("descriptive_stats_by_class", f"""{S} """ + " UNION ALL ".join(f"""SELECT target, '{c}' AS "column", {_STATS.replace('$', c)} FROM (SELECT *, avg({c}) OVER (PARTITION BY target) AS m FROM survey) GROUP BY target""" for c in ("age", "balance", "pressure")),
       "mean std min max skew kurtosis q25 median q75", 4)
def _(spark, sf):
    return rounded(profile.descriptive_stats(fixtures.survey(spark, sf), ["age", "balance", "pressure"], ["target"]), 4)


_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, 100.0*(count(*) - count({c}))/count(*) AS missing_pct,
      count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS n_unique, 100.0*(count(DISTINCT {c}) + max(({c} IS NULL)::INT))/count(*) AS unique_pct,
      (SELECT {c}::VARCHAR FROM survey GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR NULLS FIRST LIMIT 1) AS top_value,
      100.0*(SELECT count(*) FROM survey GROUP BY {c} ORDER BY 1 DESC LIMIT 1)/count(*) AS top_pct FROM survey"""
    for c in ("id", "age", "pressure", "gender", "priority", "city", "family_history", "sensitive", "target"))


@query("column_profile", f"{S} {_PROFILE}", "missing_pct unique_pct top_pct")
def _(spark, sf):
    df = fixtures.survey(spark, sf).drop("balance", "price")
    return rounded(profile.column_profile(df).drop("dtype"))


@query("class_distribution", f"{S} SELECT target AS label, count(*) AS n, 100.0*count(*)/sum(count(*)) OVER () AS pct FROM survey GROUP BY target", "pct")
def _(spark, sf):
    return rounded(profile.data_profile(fixtures.survey(spark, sf), "target")["classes"])


@query("low_variance_columns", """WITH c AS (SELECT 'lang' AS "column", lang AS v, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'toxic', toxic::VARCHAR, count(*) FROM labels GROUP BY toxic)
   SELECT 'flag' AS "column", 2::BIGINT AS n_unique, 'common' AS top_value, 100.0*(SELECT count(*) FROM documents WHERE doc_id % 50 <> 0)/(SELECT count(*) FROM documents) AS top_pct""", "top_pct")
def _(spark, sf):
    docs = fixtures.table(spark, sf, "documents").select("lang", F.when(F.col("doc_id") % 50 != 0, "common").otherwise("odd").alias("flag"))
    return rounded(profile.near_constant(profile.column_profile(docs)))


@query("table_quality", f"""SELECT count(*) AS rows, 3::BIGINT AS columns, sum((v IS NULL)::INT)::BIGINT AS missing, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, nullif(value,0) FROM events)) AS unique_rows,
   count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, nullif(value,0) FROM events)) AS duplicate_rows, 100.0*(1 - sum((v IS NULL)::INT)/(count(*)*3.0)) AS completeness_pct
   FROM (SELECT nullif(value,0) AS v FROM events)""", "completeness_pct")
def _(spark, sf):
    df = fixtures.table(spark, sf, "events").select("user_id", "event_type", F.nullif(F.col("value"), F.lit(0.0)).alias("value"))
    return rounded(profile.quality(df))


@query("missing_table", f"""{S} SELECT 'pressure' AS "column", count(*) - count(pressure) AS missing, 100.0*(count(*) - count(pressure))/count(*) AS missing_pct FROM survey""", "missing_pct")
def _(spark, sf):
    return rounded(profile.missing_table(fixtures.survey(spark, sf)))


_RARE = """rare AS (SELECT 'source' AS "column", source AS value, count(*) AS n, 100.0*count(*)/(SELECT count(*) FROM documents) AS pct FROM documents GROUP BY source
   UNION ALL SELECT 'lang', lang, count(*), 100.0*count(*)/(SELECT count(*) FROM documents) FROM documents GROUP BY lang)"""


@query("rare_categories", f"WITH {_RARE} SELECT * FROM rare r WHERE pct < 5 AND (SELECT count(*) FROM rare x WHERE x.\"column\" = r.\"column\") <= 20", "pct")
def _(spark, sf):
    return rounded(profile.rare_categories(fixtures.table(spark, sf, "documents").select("source", "lang"), share=5.0))


_GATES = f"""gates AS (SELECT 'positive_rate' AS gate, 'target' AS detail, 100.0*avg(target) AS value FROM survey HAVING avg(target) > 0.55
   UNION ALL SELECT 'sensitive_rate', 'sensitive', 100.0*avg((sensitive='Yes')::INT) FROM survey HAVING avg((sensitive='Yes')::INT) > 0.5
   UNION ALL SELECT 'missing_values', 'pressure', (count(*)-count(pressure))::DOUBLE FROM survey HAVING count(*) > count(pressure)
   UNION ALL SELECT 'rare_category', c, count(*)::DOUBLE FROM (
     SELECT 'gender' AS c, gender, count(*) AS n FROM survey GROUP BY gender UNION ALL SELECT 'priority', priority, count(*) FROM survey GROUP BY priority
     UNION ALL SELECT 'city', city, count(*) FROM survey GROUP BY city UNION ALL SELECT 'family_history', family_history, count(*) FROM survey GROUP BY family_history
     UNION ALL SELECT 'sensitive', sensitive, count(*) FROM survey GROUP BY sensitive) WHERE 100.0*n/(SELECT count(*) FROM survey) < 1 GROUP BY c)"""


@query("quality_warnings", f"{S}, {_GATES} SELECT * FROM gates", "value")
def _(spark, sf):
    return rounded(profile.quality_warnings(fixtures.survey(spark, sf), "target", "sensitive"))


@query("data_review", f"""{S}, {_GATES}, tops AS (SELECT id AS top, 1 AS n FROM survey)
   SELECT 'missing' AS section, 'pressure' AS "column", 'count' AS key, (count(*)-count(pressure))::DOUBLE AS value FROM survey
   UNION ALL (SELECT 'dropped', 'city', city, 100.0*count(*)/(SELECT count(*) FROM survey) FROM survey GROUP BY city ORDER BY count(*) DESC, city LIMIT 1)
   UNION ALL SELECT 'warning', detail, gate, value FROM gates WHERE detail <> 'city'""", "value")
def _(spark, sf):
    return rounded(profile.data_review(fixtures.survey(spark, sf), "target", "sensitive", ["city"]))


@query("class_imbalance", """SELECT quality AS label, count(*) AS n, count(*)/sum(count(*)) OVER () AS ratio, max(count(*)) OVER ()/min(count(*)) OVER () AS imbalance_ratio,
   CASE WHEN max(count(*)) OVER ()/min(count(*)) OVER () > 10 THEN 'severe' WHEN max(count(*)) OVER ()/min(count(*)) OVER () > 3 THEN 'moderate' ELSE 'acceptable' END AS severity FROM labels GROUP BY quality""", "ratio imbalance_ratio")
def _(spark, sf):
    return rounded(profile.class_imbalance(fixtures.table(spark, sf, "labels"), "quality"))


def _cross(cols):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c}::VARCHAR AS level, target::VARCHAR AS other, count(*) AS n, 100.0*count(*)/sum(count(*)) OVER (PARTITION BY {c}) AS row_pct
        FROM survey WHERE {c} IS NOT NULL GROUP BY {c}, target""" for c in cols)


@query("crosstab", f"{S} {_cross(['gender', 'priority', 'pressure'])}", "row_pct")
def _(spark, sf):
    return rounded(profile.crosstab(fixtures.survey(spark, sf), ["gender", "priority", "pressure"], "target"))


@query("target_rate", f"""{S} SELECT 'sensitive' AS "column", sensitive AS level, count(*) AS n, avg(target) AS target_rate FROM survey GROUP BY 2
   UNION ALL SELECT 'city', city, count(*), avg(target) FROM survey GROUP BY 2""", "target_rate")
def _(spark, sf):
    return rounded(profile.target_rate(fixtures.survey(spark, sf), ["sensitive", "city"], "target"))


@query("synthetic_check", f"""{S}, s AS (SELECT count(*) AS rows, 100.0*avg((sensitive='Yes')::INT) AS sensitive_pct, 100.0*avg(target) AS target_pct, avg(age) AS age_mean, stddev_pop(age) AS age_std,
   min(age)::BIGINT AS age_min, max(age)::BIGINT AS age_max, 100.0*avg((age BETWEEN 18 AND 24)::INT) AS age_18_24_pct, avg(balance) AS score_mean, stddev_pop(balance) AS score_std,
   min(balance) AS score_min, max(balance) AS score_max, 100.0*avg((family_history='Yes')::INT) AS binary_yes_pct, count(DISTINCT city) AS n_cities,
   (SELECT city FROM survey GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_city, 100.0*(SELECT count(*) FROM survey GROUP BY city ORDER BY 1 DESC LIMIT 1)/count(*) AS top_city_pct FROM survey),
  f AS (SELECT *, CASE WHEN sensitive_pct > 50 THEN 'very high' WHEN sensitive_pct > 30 THEN 'high' ELSE 'normal' END AS sensitive_level,
   CASE WHEN target_pct > 50 THEN 'very high' WHEN target_pct > 30 THEN 'high' ELSE 'normal' END AS target_level, CASE WHEN age_18_24_pct < 50 THEN 'unusual' ELSE 'normal' END AS age_level,
   CASE WHEN binary_yes_pct > 40 AND binary_yes_pct < 60 THEN 'too balanced' ELSE 'normal' END AS binary_level FROM s)
  SELECT *, (sensitive_level<>'normal')::INT + (target_level<>'normal')::INT + (age_level<>'normal')::INT + (binary_level<>'normal')::INT AS total_warnings,
   (sensitive_level<>'normal')::INT + (target_level<>'normal')::INT + (age_level<>'normal')::INT + (binary_level<>'normal')::INT >= 3 AS likely_synthetic FROM f""",
       "sensitive_pct target_pct age_mean age_std age_18_24_pct score_mean score_std binary_yes_pct top_city_pct")
def _(spark, sf):
    return rounded(profile.synthetic_check(
        fixtures.survey(spark, sf), "target", "sensitive", "age", "balance", "city", "family_history"))


@query("correlation_matrix", f"{S} " + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a},{b}) AS r FROM survey"
    for a, b in (("age", "balance"), ("age", "price"), ("age", "pressure"), ("balance", "price"), ("balance", "pressure"), ("price", "pressure"))), "r")
def _(spark, sf):
    return rounded(profile.correlation_matrix(fixtures.survey(spark, sf), ["age", "balance", "price", "pressure"]))


# ---------------------------------------------------------------- ranks, top-k, samples

@query("average_ranks", """SELECT l_extendedprice, count(*) AS n, avg(r) AS rank FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS r FROM lineitem) GROUP BY 1""", "rank")
def _(spark, sf):
    return rounded(rank.rank_average(fixtures.table(spark, sf, "lineitem"), "l_extendedprice"))


@query("running_totals", """SELECT c_mktsegment, c_acctbal, count(*) AS n, sum(count(*)) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal)::BIGINT AS cum_n FROM customer GROUP BY 1, 2""")
def _(spark, sf):
    df = fixtures.table(spark, sf, "customer")
    cells = df.groupBy("c_mktsegment", "c_acctbal").agg(F.count(F.lit(1)).alias("n"))
    bounds = rank.range_bounds(df, ["c_acctbal"])["c_acctbal"]
    return rank.running_totals(cells, "c_acctbal", ["n"], ["c_mktsegment"], F.expr(rank.bucket_sql("c_acctbal", bounds))).drop("tot_n")


@query("exact_quantiles", """SELECT l_returnflag, 'l_extendedprice' AS "column", count(*) AS n, quantile_cont(l_extendedprice,0.05) AS q5, quantile_cont(l_extendedprice,0.5) AS q50, quantile_cont(l_extendedprice,0.975) AS q97_5 FROM lineitem GROUP BY 1
   UNION ALL SELECT l_returnflag, 'l_tax', count(*), quantile_cont(l_tax,0.05), quantile_cont(l_tax,0.5), quantile_cont(l_tax,0.975) FROM lineitem GROUP BY 1""", "q5 q50 q97_5")
def _(spark, sf):
    return rounded(rank.quantiles(fixtures.table(spark, sf, "lineitem"), ["l_extendedprice", "l_tax"], [0.05, 0.5, 0.975], ["l_returnflag"]))


@query("top_categories", f"""{S}, top AS (SELECT city FROM survey GROUP BY 1 ORDER BY count(*) DESC, city LIMIT 10)
   SELECT CASE WHEN city IN (SELECT city FROM top) THEN city ELSE 'Other' END AS category, count(*) AS n, avg(target) AS rate FROM survey GROUP BY 1 HAVING count(*) >= 30""", "rate")
def _(spark, sf):
    rows = profile.top_categories(fixtures.survey(spark, sf), "city")
    return rounded(rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("rate")))


@query("chart_sample", """SELECT event_id, event_type, value FROM events ORDER BY ('0x'||substr(md5(event_id||'-sample'),1,8))::BIGINT, event_id LIMIT 500""")
def _(spark, sf):
    return charts.sample_rows(fixtures.table(spark, sf, "events"), "event_id", 500).select("event_id", "event_type", "value")


# ---------------------------------------------------------------- chart tables

@query("class_shares", f"""{S}, c AS (SELECT target AS label, count(*) AS n, 100.0*count(*)/sum(count(*)) OVER () AS pct FROM survey GROUP BY target)
   SELECT *, max(pct) OVER () - min(pct) OVER () AS imbalance_pct FROM c""", "pct imbalance_pct")
def _(spark, sf):
    return rounded(charts.class_shares(fixtures.survey(spark, sf), "target"))


_BOX = " UNION ALL ".join(f"""SELECT l_returnflag, '{c}' AS "column", count(*) AS n, min({c}) AS min, any_value(q25) AS q25, any_value(q50) AS median, any_value(q75) AS q75, max({c}) AS max, avg({c}) AS mean,
   min({c}) FILTER ({c} BETWEEN q25 - 1.5*(q75-q25) AND q75 + 1.5*(q75-q25)) AS whisker_low, max({c}) FILTER ({c} BETWEEN q25 - 1.5*(q75-q25) AND q75 + 1.5*(q75-q25)) AS whisker_high,
   count(*) FILTER (NOT {c} BETWEEN q25 - 1.5*(q75-q25) AND q75 + 1.5*(q75-q25)) AS outliers
   FROM lineitem JOIN (SELECT l_returnflag AS f, quantile_cont({c},0.25) AS q25, quantile_cont({c},0.5) AS q50, quantile_cont({c},0.75) AS q75 FROM lineitem GROUP BY 1) ON f=l_returnflag GROUP BY l_returnflag"""
   for c in ("l_quantity", "l_extendedprice"))


@query("box_stats", _BOX, "min q25 median q75 max mean whisker_low whisker_high", 4)
def _(spark, sf):
    return rounded(charts.box_stats(fixtures.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"]), 4)


@query("density_by_group", """WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
   b AS (SELECT event_type, least(floor((value-lo)/((hi-lo)/200)),199) AS slot, count(*) AS w FROM events, r GROUP BY ALL),
   g AS (SELECT event_type, count(*) AS n, stddev_samp(value)*pow(count(*),-0.2) AS h FROM events GROUP BY event_type)
   SELECT event_type, lo + i*(hi-lo)/99 AS x, sum(w*exp(-0.5*pow((lo + i*(hi-lo)/99 - (lo + (slot+0.5)*(hi-lo)/200))/greatest(h,(hi-lo)/400),2)))/(any_value(n)*any_value(greatest(h,(hi-lo)/400))*sqrt(2*pi())) AS density
   FROM b JOIN g USING (event_type), r, range(100) t(i) GROUP BY event_type, i, lo, hi""", "x density")
def _(spark, sf):
    return rounded(charts.density(fixtures.table(spark, sf, "events"), "value", ["event_type"]))


@query("stacked_shares", f"""{S} SELECT * FROM ({_cross(['gender', 'priority', 'family_history', 'sensitive'])})""", "row_pct")
def _(spark, sf):
    return rounded(charts.stacked_shares(fixtures.survey(spark, sf), "target"))


@query("histogram", """WITH r AS (SELECT min(value) AS lo, (max(value)-min(value))/30 AS w FROM events)
   SELECT event_type, bin, lo + bin*w AS "left", lo + bin*w + w AS "right", n FROM (SELECT event_type, least(floor((value-lo)/w),29)::INTEGER AS bin, count(*) AS n FROM events, r GROUP BY ALL), r""", '"left" "right"')
def _(spark, sf):
    return rounded(charts.histogram(fixtures.table(spark, sf, "events"), "value", by=["event_type"]))


@query("threshold_counts", "SELECT event_type, count(*) FILTER (value < 16) AS below, count(*) FILTER (value >= 16) AS at_or_above FROM events GROUP BY 1")
def _(spark, sf):
    return charts.threshold_counts(fixtures.table(spark, sf, "events"), "value", 16, ["event_type"])


@query("trend_line", """SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1""", "slope intercept r2", 4)
def _(spark, sf):
    return rounded(charts.trend_line(fixtures.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), 4)


@query("bar_by_group", "SELECT c_mktsegment, avg(c_acctbal) AS c_acctbal_mean FROM customer GROUP BY 1", "c_acctbal_mean")
def _(spark, sf):
    return rounded(charts.bar_by_group(fixtures.table(spark, sf, "customer"), "c_mktsegment", "c_acctbal"))


@query("time_trend", """SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2""", "mean")
def _(spark, sf):
    return rounded(charts.time_trend(fixtures.table(spark, sf, "events"), "ts", "value", ["event_type"]))


@query("category_distribution", "SELECT event_type AS category, count(*) AS n, 100.0*count(*)/sum(count(*)) OVER () AS pct FROM events GROUP BY 1", "pct")
def _(spark, sf):
    return rounded(charts.category_distribution(fixtures.table(spark, sf, "events"), "event_type"))


@query("category_by_group", 'SELECT lang AS category, source AS "group", count(*) AS n FROM documents GROUP BY ALL')
def _(spark, sf):
    return charts.category_by_group(fixtures.table(spark, sf, "documents"), "lang", "source")


@query("sensitive_by_target", f"{S} {_cross(['sensitive'])}", "row_pct")
def _(spark, sf):
    return rounded(charts.eda_tables(fixtures.survey(spark, sf), "target", "sensitive")["sensitive"])


@query("eda_summary", f"{S} SELECT count(*) AS rows, 11::INTEGER AS columns, 1::INTEGER AS columns_with_nulls, 100.0*avg(target) AS positive_pct FROM survey", "positive_pct")
def _(spark, sf):
    return rounded(charts.eda_summary(fixtures.survey(spark, sf), "target"))
