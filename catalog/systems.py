"""Source, sink, log, run and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SURVEY, query, u
from catalog.modelling import FULL
from catalog.tables import ROLES
from cohort import fixtures
from cohort.functions.columns import rounded
from cohort.operators import charts, clean, logs, models as M
from cohort.plans import analyses, deploy, runs
from cohort.sources import artifacts, tables as T
from cohort.streaming import scoring, trend

S = f"WITH {SURVEY}"
QUICK = {"logistic": {"max_iter": 50}, "boosted": {"iterations": 5, "depth": 3, "learning_rate": 0.1, "early_stopping_rounds": None},
         "gam": {"n_splines": 6, "optimize": False}}


# ---------------------------------------------------------------- sources and sinks

@query("csv_scan", "SELECT c_custkey::INTEGER AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = T.scratch_path(spark, "customer_csv")
    T.write_csv(fixtures.table(spark, sf, "customer"), path)
    return T.read_csv(spark, path)


@query("csv_roundtrip", "SELECT * FROM orders")
def _(spark, sf):
    path = T.scratch_path(spark, "orders_csv")
    orders = fixtures.table(spark, sf, "orders")
    T.write_csv(orders, path)
    return T.read_csv(spark, path, orders.schema)


@query("parquet_scan", "SELECT n_name, r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ALL")
def _(spark, sf):
    load = lambda n: T.read_parquet(spark, f"{sf}/{n}.parquet")
    joined = load("supplier").join(load("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(load("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("suppliers"))


@query("parquet_roundtrip", "SELECT * FROM lineitem")
def _(spark, sf):
    path = T.scratch_path(spark, "lineitem")
    T.write_parquet(fixtures.table(spark, sf, "lineitem"), path)
    return T.read_parquet(spark, path)


@query("json_roundtrip", "SELECT event_id, user_id, event_type, nullif(value, 0) AS value, props FROM events")
def _(spark, sf):
    path = T.scratch_path(spark, "events_json")
    events = fixtures.table(spark, sf, "events").select("event_id", "user_id", "event_type", F.nullif(F.col("value"), F.lit(0.0)).alias("value"), "props")
    T.write_json(events, path)
    return T.read_json(spark, path, events.schema)


@query("schema_issues", """SELECT c AS "column", r AS role, p AS present, f::DOUBLE AS found_pct FROM (VALUES ('target','target',true), ('age','feature',true), ('absent','feature',false), ('city','feature',true)) v(c,r,p),
   (SELECT 100.0*2/3 AS f)""", "found_pct")
def _(spark, sf):
    roles = FULL.__class__("target", "id", ["age", "absent"], [], ["city"], None, [])
    return rounded(T.schema_issues(fixtures.survey(spark, sf), roles))


@query("cached_csv", "SELECT * FROM (VALUES (false), (true)) v(from_cache), (SELECT count(*) AS n, sum(c_acctbal) AS total FROM customer)", "total", 4)
def _(spark, sf):
    source, cache = T.scratch_path(spark, "customer.csv"), T.scratch_path(spark, "cache")
    T.write_csv(fixtures.table(spark, sf, "customer"), source)
    loads = [T.load_cached(spark, source, cache) for _ in range(2)]
    parts = [x.frame.agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total")).withColumn("from_cache", F.lit(x.from_cache)) for x in loads]
    return rounded(parts[0].unionByName(parts[1]), 4)


@query("generated_sample", f"""SELECT c_custkey AS student_id, (15 + floor({u('c_custkey', 'sample:age')}*15))::INTEGER AS age, CASE WHEN floor({u('c_custkey', 'sample:gender')}*2)=0 THEN 'Nam' ELSE 'Nữ' END AS gender,
   CASE floor({u('c_custkey', 'sample:education')}*3) WHEN 0 THEN 'High School' WHEN 1 THEN 'University' ELSE 'Graduate' END AS education_level,
   floor(greatest(0, least(27, 12 + 5*sqrt(-2*ln(greatest({u('c_custkey', 'sample:score:r')}, pow(2::DOUBLE,-33))))*cos(6.283185307179586::DOUBLE*{u('c_custkey', 'sample:score:t')}))))::INTEGER AS depression_score,
   (1 + floor({u('c_custkey', 'sample:stress')}*10))::INTEGER AS stress_level FROM customer""")
def _(spark, sf):
    rows = T.sample_survey(fixtures.table(spark, sf, "customer"), "c_custkey")
    return rows.select("student_id", "age", "gender", "education_level", "depression_score", "stress_level")


@query("artifact_catalogue", "SELECT event_type AS workflow, 1::BIGINT AS files FROM events GROUP BY 1")
def _(spark, sf):
    root = T.scratch_path(spark, "reports")
    summary = fixtures.table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("total"))
    summary.repartition("event_type").write.partitionBy("event_type").json(root)
    files = artifacts.scan_artifacts(spark, [root], ".json")
    workflow = F.regexp_extract("path", "event_type=([^/]+)", 1)
    return artifacts.latest_per_workflow(files, workflow).groupBy("workflow").agg(F.count(F.lit(1)).alias("files"))


@query("run_history", """SELECT 'run_'||c_custkey||'.json' AS name, 'run' AS workflow, 'quick' AS preset, CASE WHEN c_custkey%2=0 THEN 'safe' ELSE 'full' END AS profile, c_custkey AS rows, 0.2::DOUBLE AS test_size, 'logistic, gam' AS models FROM customer WHERE c_custkey%3=0
   UNION ALL SELECT 'x_'||c_custkey||'.json', 'compare', 'research', NULL, -1, -1, 'logistic, gam' FROM customer WHERE c_custkey%3=1
   UNION ALL SELECT 'fairness_'||c_custkey||'.json', 'fairness', NULL, NULL, -1, -1, '' FROM customer WHERE c_custkey%3=2""")
def _(spark, sf):
    k = F.col("c_custkey")
    run = F.concat(F.lit('{"config": {"preset": "quick", "profile": "'), F.when(k % 2 == 0, "safe").otherwise("full"), F.lit(
        '", "models": ["logistic", "gam"]}, "dataset": {"rows": '), k.cast("string"), F.lit('}, "split": {"test_size": 0.2}, "models": {}}'))
    content = F.when(k % 3 == 0, run).when(k % 3 == 1, '{"preset": "research", "profiles": {}, "summary": {"logistic": {}, "gam": {}}}').otherwise('{"equalized": 1}')
    stem = F.when(k % 3 == 0, "run_").when(k % 3 == 1, "x_").otherwise("fairness_")
    reports = fixtures.table(spark, sf, "customer").select(F.concat(F.lit("out/"), stem, k.cast("string"), F.lit(".json")).alias("path"), content.alias("content"))
    out = artifacts.run_history(reports).select("name", "workflow", "preset", "profile", "rows", "test_size", "models")
    return out.fillna(-1, ["rows"]).fillna(-1.0, ["test_size"]).fillna("", ["models"])


# ---------------------------------------------------------------- run logs

_LOGS = """k AS (SELECT o_orderkey AS k, o_orderpriority AS p, ['eda','run','compare','fairness','models','profile'][o_orderkey%6+1] AS w,
   (50+o_orderkey%50)::INTEGER AS a, (50+o_orderkey*7%50)::INTEGER AS b FROM orders),
  l AS (SELECT *, 'logs/20260424_'||CASE WHEN length(k::VARCHAR) >= 6 THEN substr(k::VARCHAR,1,6) ELSE lpad(k::VARCHAR,6,'0') END||'_'||w||'_A_quick_default.log' AS path FROM k)"""


def _parsed(spark, sf):
    """Parsed logs, kept: every fact table reads the body many times."""
    return logs.parse_logs(fixtures.run_logs(spark, sf)).persist()


@query("log_headers", f"""WITH {_LOGS} SELECT path, w AS workflow, CASE WHEN k%7<>0 THEN 'legacy' END AS family, CASE WHEN k%7<>0 THEN p||'.csv' END AS dataset, CASE WHEN k%7<>0 THEN 'A / safe' END AS variant,
   CASE WHEN k%7<>0 THEN '2026-04-24T09:19:11' END AS "timestamp" FROM l""")
def _(spark, sf):
    return _parsed(spark, sf).select("path", "workflow", "family", "dataset", "variant", "timestamp")


@query("log_counts", f"""WITH {_LOGS} SELECT path, CASE w WHEN 'eda' THEN 7 WHEN 'run' THEN 3 WHEN 'compare' THEN 1 WHEN 'fairness' THEN 7 WHEN 'models' THEN 7 ELSE 3 END::INTEGER AS n_lines,
   CASE w WHEN 'eda' THEN 2 WHEN 'fairness' THEN 1 WHEN 'profile' THEN 1 ELSE 0 END::INTEGER AS warnings, w='fairness' AS failed, CASE w WHEN 'eda' THEN 2 WHEN 'fairness' THEN 1 ELSE 0 END::INTEGER AS n_durations,
   CASE w WHEN 'eda' THEN 1+(a+b)/100.0 WHEN 'fairness' THEN 2+a/100.0 ELSE 0 END AS total_seconds, CASE WHEN w='run' THEN 1 ELSE 0 END::INTEGER AS html, CASE WHEN w IN ('run','fairness') THEN 1 ELSE 0 END::INTEGER AS json,
   CASE WHEN w='models' THEN 1 ELSE 0 END::INTEGER AS markdown FROM l""", "total_seconds")
def _(spark, sf):
    counts = logs.log_counts(_parsed(spark, sf))
    return rounded(counts.select("path", "n_lines", "warnings", "failed", "n_durations", "total_seconds", "html", "json", "markdown"))


@query("log_model_metrics", f"""WITH {_LOGS} SELECT path, 'logistic' AS model, a/100.0 AS roc_auc, CASE w WHEN 'run' THEN 0.71 ELSE 0.5 END AS f1 FROM l WHERE w IN ('run','models')
   UNION ALL SELECT path, 'gam', b/100.0, NULL FROM l WHERE w='run' UNION ALL SELECT path, 'catboost', b/100.0, 0.6 FROM l WHERE w='models'""", "roc_auc f1")
def _(spark, sf):
    parsed = _parsed(spark, sf).filter(F.col("workflow").isin("run", "models"))
    return rounded(logs.model_metrics(parsed))


@query("log_training_facts", f"""WITH {_LOGS}, m AS (SELECT path, CASE w WHEN 'run' THEN 'gam' ELSE 'catboost' END AS other, a/100.0 AS ra, b/100.0 AS rb, CASE w WHEN 'run' THEN 0.71 ELSE 0.6 END AS best_f1 FROM l WHERE w IN ('run','models'))
   SELECT path, 2::BIGINT AS n_models, CASE WHEN ra > rb OR (ra = rb AND 'logistic' < other) THEN 'logistic' ELSE other END AS best_model, CASE WHEN ra < rb OR (ra = rb AND 'logistic' > other) THEN 'logistic' ELSE other END AS weakest_model,
     greatest(ra, rb) AS best_auc, best_f1, abs(ra-rb) AS auc_spread, greatest(ra,rb) >= 0.9 AS check_leakage FROM m""", "best_auc best_f1 auc_spread")
def _(spark, sf):
    return rounded(logs.training_facts(_parsed(spark, sf)))


@query("log_compare_facts", f"""WITH {_LOGS} SELECT path, 2::BIGINT AS n_models, 'logistic' AS best_gain_model, a/100.0 AS best_gain, 'gam' AS worst_gain_model, -0.1 AS worst_gain, 0.1 AS best_f1_gain, 'full_gains_check_leakage' AS advice FROM l WHERE w='compare'""", "best_gain worst_gain best_f1_gain")
def _(spark, sf):
    return rounded(logs.compare_facts(_parsed(spark, sf)))


@query("log_eda_facts", f"""WITH {_LOGS} SELECT path, 1000+k AS rows, 18::BIGINT AS cols, a+0.55 AS positive_pct, b+0.3 AS sensitive_pct, 6::BIGINT AS charts, 1+a/100.0 AS eda_seconds, b/100.0 AS review_seconds, 1::BIGINT AS missing_columns,
   CASE WHEN b+0.3 < 60 THEN 'medium' ELSE 'high' END AS leakage, CASE WHEN a+0.55 > 55 THEN 'stratify' ELSE 'ready' END AS readiness FROM l WHERE w='eda'""", "positive_pct sensitive_pct eda_seconds review_seconds")
def _(spark, sf):
    return rounded(logs.eda_facts(_parsed(spark, sf)).drop("rare_columns", "workflow"))


@query("log_assessment", f"""WITH {_LOGS} SELECT w AS workflow, 'log' AS section, key, count(*) AS n FROM l, (VALUES ('n_lines'),('n_chars'),('warnings'),('failed'),('n_durations'),('html'),('json'),('markdown')) v(key) GROUP BY ALL
   UNION ALL SELECT w, 'log', 'last_seconds', count(*) FROM l WHERE w IN ('eda','fairness') GROUP BY w
   UNION ALL SELECT w, 'training', key, count(*) FROM l, (VALUES ('n_models'),('best_model'),('weakest_model'),('best_auc'),('best_f1'),('auc_spread'),('check_leakage')) v(key) WHERE w IN ('run','models') GROUP BY ALL
   UNION ALL SELECT w, 'compare', key, count(*) FROM l, (VALUES ('n_models'),('best_gain_model'),('best_gain'),('worst_gain_model'),('worst_gain'),('best_f1_gain'),('advice')) v(key) WHERE w='compare' GROUP BY ALL
   UNION ALL SELECT w, 'eda', key, count(*) FROM l, (VALUES ('rows'),('cols'),('positive_pct'),('sensitive_pct'),('charts'),('eda_seconds'),('review_seconds'),('missing_columns'),('leakage'),('readiness')) v(key) WHERE w='eda' GROUP BY ALL
   UNION ALL SELECT w, 'profile', key, count(*) FROM l, (VALUES ('rows'),('cols'),('positive_pct'),('safe_columns'),('full_columns')) v(key) WHERE w='profile' GROUP BY ALL
   UNION ALL SELECT w, 'advanced', key, count(*) FROM l, (VALUES ('n_models'),('models'),('blocks')) v(key) WHERE w='fairness' GROUP BY ALL""")
def _(spark, sf):
    return logs.log_assessment(fixtures.run_logs(spark, sf)).groupBy("workflow", "section", "key").agg(F.count(F.lit(1)).alias("n"))


@query("mojibake_repair")
def _(spark, sf):
    docs = fixtures.table(spark, sf, "documents")
    # UTF-8 bytes taken for Latin-1, then repaired where three or more characters look wrong
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", logs.repair_mojibake(broken).alias("text"))


# ---------------------------------------------------------------- runs and deployment

def _families():
    return {"gender": "gender", "age": clean.band("age"), "family_history": "family_history"}


@query("holdout_run")
def _(spark, sf):
    out = runs.holdout_run(fixtures.survey(spark, sf), ROLES, "full", ("logistic", "gam", "boosted"), QUICK, oof=False, attributes=_families())
    return rounded(out["metrics"])


@query("holdout_subgroups")
def _(spark, sf):
    out = runs.holdout_run(fixtures.survey(spark, sf), ROLES, "safe", ("logistic",), QUICK, oof=True, k=3, attributes=_families())
    return rounded(out["subgroups"])


@query("profile_comparison")
def _(spark, sf):
    return rounded(runs.compare_profiles(fixtures.survey(spark, sf), ROLES, models=("logistic",), params=QUICK, oof=False)["delta"])


@query("train_best")
def _(spark, sf):
    path = T.scratch_path(spark, "deployment")
    df = fixtures.survey(spark, sf).persist()
    _deployment, choice = runs.train_best(df, ROLES, path, models=("logistic",), params=QUICK, oof=False)
    loaded = deploy.load_deployment(spark, path)
    flagged = loaded.predict(df).groupBy("model", "profile").agg(F.count(F.lit(1)).alias("rows"), F.sum("prediction").alias("flagged"))
    return rounded(choice.join(flagged, ["model", "profile"]))


@query("batch_scoring")
def _(spark, sf):
    df = fixtures.survey(spark, sf).persist()
    deployment = deploy.fit_deployment(df, ROLES, "logistic", "safe", 0.4, max_iter=50)
    return rounded(deployment.predict(df).drop("disclaimer"))


@query("score_csv_file")
def _(spark, sf):
    df = fixtures.survey(spark, sf).persist()
    deployment = deploy.fit_deployment(df, ROLES, "logistic", "safe", 0.4, max_iter=50)
    source, target = T.scratch_path(spark, "records.csv"), T.scratch_path(spark, "scored.json")
    T.write_csv(df, source)
    deploy.predict_file(spark, deployment, source, target)
    return T.read_json(spark, target).groupBy("risk_label", "model", "profile").agg(F.count(F.lit(1)).alias("n"))


@query("result_tables", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    events = fixtures.table(spark, sf, "events")
    paths = T.write_tables({"types": charts.category_distribution(events, "event_type")}, T.scratch_path(spark, "results"))
    return T.read_parquet(spark, paths["types"]).select(F.col("category").alias("event_type"), "n")


# ---------------------------------------------------------------- streams

@query("stream_trend", """SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2""", "mean")
def _(spark, sf):
    source, out, progress = (T.scratch_path(spark, n) for n in ("events", "trend", "progress"))
    events = fixtures.table(spark, sf, "events").select("ts", "event_type", "value")
    # a closing row far in the future moves the watermark past the last window
    last = events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select("ts", F.lit("__close").alias("event_type"), F.lit(0.0).alias("value"))
    T.write_parquet(events, source + "/part=0")
    T.write_parquet(last, source + "/part=1")
    stream = spark.readStream.schema(events.schema).parquet(source + "/*")
    trend.run_to_parquet(trend.stream_trend(stream, "ts", "value", ["event_type"]), out, progress)
    return rounded(spark.read.parquet(out).filter("event_type <> '__close'"))


@query("stream_scoring")
def _(spark, sf):
    df = fixtures.survey(spark, sf).persist()
    deployment = deploy.fit_deployment(df, ROLES, "logistic", "safe", 0.4, max_iter=50)
    source, out, progress = (T.scratch_path(spark, n) for n in ("records", "scored", "progress"))
    T.write_parquet(df, source)
    scoring.score_to_parquet(spark.readStream.schema(df.schema).parquet(source), deployment, out, progress)
    return rounded(spark.read.parquet(out).drop("disclaimer"))


@query("fairness_analysis_groups")
def _(spark, sf):
    return rounded(analyses.fairness_analysis(fixtures.scored(spark, sf), _families())["groups"])


@query("subgroup_analysis_errors")
def _(spark, sf):
    return rounded(analyses.subgroup_analysis(fixtures.scored(spark, sf), _families(), profile_columns=["gender"])["errors"])
