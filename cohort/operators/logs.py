"""Analytics over many run logs, one row per log: ``path, content``.

Parsing is built-in string and array functions. What depends on earlier lines works on line rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohort.functions.columns import join_groups
from cohort.sources.artifacts import file_name, file_stem

# Fixed values of the log format.
MARKER = "=== console result ==="
HEADER_KEYS = ["workflow", "family", "dataset", "variant", "preset", "training_budget_mode", "timestamp"]
WARNING_MARKS = ["[quality gate]", "warning", "cảnh báo", "⚠"]
FAILURE_MARKS = ["workflow failed", "traceback", "exception", "attributeerror", "typeerror"]
COMPLETED = r"(?i)completed in\s*([\d.]+)s"
ARTIFACT = r"(?iU)[\w./\\-]+\.(?:html|json|md)"
ROC = r"(?i)roc[- ]?auc[:=\s]+([0-9.]+)"
F1 = r"(?i)\bf1[:=\s]+([0-9.]+)"
SHAPE = r"Shape:\s*([\d,]+)\s*rows\s*[×x]\s*([\d,]+)\s*cols"
POSITIVE = r"\(1\):\s*[\d,]+\s*\(([\d.]+)%\)"
SENSITIVE = r"(?i)Suicidal thoughts\s*=\s*Yes.*?=\s*([\d.]+)%"
MISSING_GATE = r"(?i)\[Quality Gate\]\s*(\d+)\s*.*?(giá trị thiếu|missing)"
RARE_GATE = r"(?i)\[Quality Gate\]\s*(\d+)\s*.*?(category hiếm|rare categor)"
SUSPICIOUS = ["Ã", "â", "ð", "�"]
SUSPICIOUS_LIMIT = 3
TRAINING = ["run", "models", "full"]
ADVANCED = ["fairness", "subgroups", "robustness", "analysis"]


def read_logs(spark: SparkSession, roots: list[str]) -> DataFrame:
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.log").text(roots)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def lines(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.split(text, "\r\n|\n|\r")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def repair_mojibake(text: str | Column = "content") -> Column:
    """UTF-8 read as Latin-1, undone: only from three suspicious characters on, and only if fewer remain."""
    text = F.col(text) if isinstance(text, str) else text
    count = lambda t: sum((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in SUSPICIOUS), F.lit(0))
    latin = F.regexp_replace(text, "[^\u0000-ÿ]", "")
    valid = F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
    fixed = F.replace(valid, F.lit("�"), F.lit(""))
    better = (count(text) >= SUSPICIOUS_LIMIT) & (F.length(fixed) > 0) & (count(fixed) < count(text))
    return F.when(better, fixed).otherwise(text)


def _name_workflow() -> Column:
    parts = F.split(file_stem(), "_")
    dated = F.get(parts, F.lit(0)).rlike(r"^\d+$")
    return F.when(dated & (F.size(parts) >= 3), F.get(parts, F.lit(2))).when(dated & (F.size(parts) >= 2), F.get(parts, F.lit(1))).otherwise("report")


def parse_logs(logs: DataFrame) -> DataFrame:
    """Header fields and body; the workflow falls back to the file name."""
    fixed = logs.withColumn("content", repair_mojibake())
    marked = F.contains("content", F.lit(MARKER))
    at = F.locate(MARKER, F.col("content"))
    body = F.when(marked, F.col("content").substr(at + len(MARKER), F.length("content"))).otherwise(F.col("content"))
    all_lines = lines("content")
    stop = F.array_position(F.transform(all_lines, strip), MARKER)
    head = F.when(stop > 0, F.slice(all_lines, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(all_lines)
    with_head = fixed.withColumn("_head", head)

    def field(key: str) -> Column:
        hits = F.filter("_head", lambda l: F.contains(l, F.lit(":")) & (strip(F.substring_index(l, ":", 1)) == key))
        last = F.get(hits, F.size(hits) - 1)
        return strip(F.regexp_replace(last, "^[^:]*:", ""))

    fields = {k: field(k) for k in HEADER_KEYS}
    fields["workflow"] = F.coalesce(fields["workflow"], _name_workflow())
    return with_head.select("path", file_name().alias("name"), *[c.alias(k) for k, c in fields.items()], strip(body).alias("body"))


def log_counts(parsed: DataFrame) -> DataFrame:
    """Lines, characters, completed durations, warnings, failure flag and artifact mentions."""
    body = F.col("body")
    seconds = F.filter(F.transform(F.regexp_extract_all(body, F.lit(COMPLETED), 1), lambda s: s.try_cast("double")), lambda v: v.isNotNull())
    mentions = F.array_distinct(F.regexp_extract_all(body, F.lit(ARTIFACT), 0))
    kind = lambda s: F.size(F.filter(mentions, lambda m: F.lower(m).endswith(s)))
    warned = F.size(F.filter(lines(body), lambda l: _any(F.lower(l), WARNING_MARKS)))
    return parsed.select(
        "*", F.when(F.length(body) > 0, F.size(lines(body))).otherwise(F.lit(0)).alias("n_lines"), F.length(body).alias("n_chars"),
        warned.alias("warnings"), _any(F.lower(body), FAILURE_MARKS).alias("failed"),
        F.size(seconds).alias("n_durations"), F.get(seconds, F.size(seconds) - 1).alias("last_seconds"), F.coalesce(F.aggregate(seconds, F.lit(0.0), lambda a, v: a + v), F.lit(0.0)).alias("total_seconds"),
        kind(".html").alias("html"), kind(".json").alias("json"), kind(".md").alias("markdown"),
    )


def _literal_json(text: Column) -> Column:
    """Python literals of a printed dict as JSON words."""
    out = F.regexp_replace(text, r"\bNone\b", "null")
    return F.regexp_replace(F.regexp_replace(out, r"\bTrue\b", "true"), r"\bFalse\b", "false")


def _from_dict(text: Column, schema: str) -> Column:
    return F.from_json(_literal_json(text), schema, {"allowSingleQuotes": "true", "allowNonNumericNumbers": "true"})


#: Lines of a log over which a window carries the last model; carries of the parts join them.
CARRY_LINES = 4096


def _last_model(rows: DataFrame, size: int) -> DataFrame:
    """Add ``_now``, the model named last on this or an earlier line: within parts of ``size`` lines, then over the parts."""
    cut = rows.withColumn("_part", F.floor(F.col("_pos") / size))
    tops = cut.groupBy("path", "_part").agg(F.max_by("_named", F.when(F.col("_named").isNotNull(), F.col("_pos"))).alias("_top"))
    earlier = Window.partitionBy("path").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    tops = tops.select("path", "_part", F.last("_top", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy("path", "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = join_groups(cut, tops, ["path", "_part"])
    return joined.withColumn("_now", F.coalesce(F.last("_named", ignorenulls=True).over(inside), F.col("_carried"))).drop("_part", "_carried")


def model_metrics(parsed: DataFrame, keep: Sequence[str] = (), carry_lines: int = CARRY_LINES) -> DataFrame:
    """``(path, keep..., model, roc_auc, f1)`` from ``label: {...}`` lines, or else from prose.

    In prose a metric belongs to the model named last on this or an earlier line; a
    model keeps the first value seen of each metric. Of printed dicts the last of a label counts.
    A log is looked at line by line; only lines that name a model or a metric go on.
    """
    schema = "holdout struct<roc_auc:double,f1:double>, roc_auc double, f1 double"
    each = parsed.select("path", *keep, F.posexplode(lines("body")).alias("_pos", "_line"))
    line, low = F.col("_line"), F.lower("_line")
    label = F.lower(F.regexp_replace(F.substring_index(line, "{", 1), r"^[\s:-]+|[\s:-]+$", ""))
    dicts = each.filter(F.contains(line, F.lit("{"))).select(
        "path", *keep, "_pos", label.alias("model"), _from_dict(strip(line.substr(F.locate("{", line), F.length(line))), schema).alias("d"))
    held = F.col("d.holdout").isNotNull()
    printed = dicts.select(
        "path", *keep, F.lit(1).alias("_kind"), "_pos", "model", *[F.when(held, F.col(f"d.holdout.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in ("roc_auc", "f1")])
    named = (F.when(F.contains(low, F.lit("logistic")), "logistic").when(F.contains(low, F.lit("catboost")), "catboost")
             .when(low.rlike(r"\bgam\b"), "gam").when(F.contains(low, F.lit("dummy")), "dummy"))
    found = lambda rx: F.when(line.rlike(rx), F.regexp_extract(line, rx, 1).try_cast("double"))
    told = each.select("path", *keep, "_pos", named.alias("_named"), found(ROC).alias("roc_auc"), found(F1).alias("f1")).filter(
        F.col("_named").isNotNull() | F.col("roc_auc").isNotNull() | F.col("f1").isNotNull())
    prose = _last_model(told, carry_lines).select("path", *keep, F.lit(0).alias("_kind"), "_pos", F.col("_now").alias("model"), "roc_auc", "f1")
    rows = printed.unionByName(prose).filter((F.length("model") > 0) & (F.col("roc_auc").isNotNull() | F.col("f1").isNotNull()))
    # the last printed dict of a label counts, the first value in prose
    pick = lambda c: F.when(
        F.col("_kind") == 1, F.max_by(c, F.col("_pos"))).otherwise(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))))
    models = rows.groupBy("path", *keep, "_kind", "model").agg(pick("roc_auc").alias("roc_auc"), pick("f1").alias("f1"))
    best = models.withColumn("_best", F.max("_kind").over(Window.partitionBy("path")))  # as many rows as a log names models
    return best.filter(F.col("_kind") == F.col("_best")).drop("_kind", "_best")


def training_facts(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Best and weakest model per training log, AUC spread and the high-score flag."""
    m = model_metrics(parsed.filter(F.col("workflow").isin(TRAINING)), keep)
    key = F.coalesce("roc_auc", F.lit(-1.0))
    s = m.groupBy("path", *keep).agg(
        F.count(F.lit(1)).alias("n_models"), F.min(F.struct((-key).alias("k"), "model")).alias("_b"), F.max(F.struct((-key).alias("k"), "model")).alias("_w"),
        F.max("roc_auc").alias("best_auc"), F.min("roc_auc").alias("worst_auc"), F.max("f1").alias("best_f1"))
    return s.select("path", *keep, "n_models", F.col("_b.model").alias("best_model"), F.col("_w.model").alias("weakest_model"), "best_auc", "best_f1",
                    (F.col("best_auc") - F.col("worst_auc")).alias("auc_spread"), F.coalesce(F.col("best_auc") >= 0.9, F.lit(False)).alias("check_leakage"))


DELTAS = "map<string,struct<safe_roc_auc:double,full_roc_auc:double,roc_auc_delta_full_minus_safe:double,safe_f1:double,full_f1:double,f1_delta_full_minus_safe:double>>"


def compare_facts(parsed: DataFrame) -> DataFrame:
    """Largest gain and loss between profiles per comparison log, with the advice they lead to."""
    rows = parsed.filter(F.col("workflow") == "compare")
    dicts = F.filter(lines("body"), lambda l: strip(l).startswith("{"))
    one = rows.select("path", _from_dict(F.get(dicts, F.lit(0)), DELTAS).alias("d")).filter(F.col("d").isNotNull())
    long = one.select("path", F.explode("d").alias("model", "m")).select("path", "model", "m.*")
    delta = F.col("roc_auc_delta_full_minus_safe")
    s = long.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_models"), F.max(delta).alias("best_gain"), F.min(delta).alias("worst_gain"),
        F.min(F.struct((-delta).alias("k"), "model")).alias("_b"), F.min(F.struct(delta.alias("k"), F.col("model").alias("model"))).alias("_w"),
        F.max("f1_delta_full_minus_safe").alias("best_f1_gain"))
    advice = F.when(F.col("best_gain") >= 0.03, "full_gains_check_leakage").when(F.col("best_gain") <= 0, "safe_not_worse").otherwise("safe_baseline")
    return s.select("path", "n_models", F.col("_b.model").alias("best_gain_model"), "best_gain", F.col("_w.model").alias("worst_gain_model"), "worst_gain", "best_f1_gain", advice.alias("advice"))


def eda_facts(parsed: DataFrame) -> DataFrame:
    """Shape, positive and sensitive rate, gates, timings and readiness of exploratory logs."""
    rows = parsed.filter(F.col("workflow") == "eda")
    body = F.col("body")
    grab = lambda rx, g=1: F.when(body.rlike(rx), F.regexp_extract(body, rx, g))
    number = lambda rx, g=1: F.replace(grab(rx, g), F.lit(","), F.lit("")).try_cast("long")
    real = lambda rx: grab(rx).try_cast("double")
    s = rows.select(
        "path", "workflow", number(SHAPE, 1).alias("rows"), number(SHAPE, 2).alias("cols"), real(POSITIVE).alias("positive_pct"), real(SENSITIVE).alias("sensitive_pct"),
        number(r"(\d+)\s+visualizations saved").alias("charts"), real(r"Exploratory Data Analysis completed in\s*([\d.]+)s").alias("eda_seconds"),
        real(r"Data Review completed in\s*([\d.]+)s").alias("review_seconds"), number(MISSING_GATE).alias("missing_columns"), number(RARE_GATE).alias("rare_columns"))
    leak = F.when(F.col("sensitive_pct").isNull(), "none").when(F.col("sensitive_pct") < 40, "low").when(F.col("sensitive_pct") < 60, "medium").otherwise("high")
    ready = F.when((F.col("positive_pct") > 55) | (F.col("positive_pct") < 45), "stratify").otherwise("ready")
    return s.select("*", leak.alias("leakage"), ready.alias("readiness"))


def profile_facts(parsed: DataFrame) -> DataFrame:
    """Size, positive rate and column counts of profile logs."""
    schema = "rows long, cols long, target_positive_rate double, selected_columns_safe array<string>, selected_columns_full array<string>"
    rows = parsed.filter(F.col("workflow") == "profile")
    dicts = F.filter(lines("body"), lambda l: strip(l).startswith("{"))
    return rows.select("path", "workflow", _from_dict(F.get(dicts, F.lit(0)), schema).alias("d")).select(
        "path", "workflow", "d.rows", "d.cols", F.col("d.target_positive_rate").alias("positive_pct"),
        F.greatest(F.size(F.coalesce("d.selected_columns_safe", F.array().cast("array<string>"))), F.lit(0)).alias("safe_columns"),
        F.greatest(F.size(F.coalesce("d.selected_columns_full", F.array().cast("array<string>"))), F.lit(0)).alias("full_columns"))


def advanced_facts(parsed: DataFrame) -> DataFrame:
    """Models named by fairness, subgroup, robustness and combined logs, and the blocks present."""
    rows = parsed.filter(F.col("workflow").isin(ADVANCED))
    subject = F.when(F.col("workflow") == "analysis", "fairness|subgroups|robustness").otherwise(F.col("workflow"))
    names = F.array_distinct(F.transform(F.regexp_extract_all("body", F.concat(F.lit("(?i)Analyzing (?:"), subject, F.lit(r") for (\w+)")), 1), lambda n: F.lower(n)))
    blocks = sum((F.contains(F.lower("body"), F.lit(b)).cast("int") for b in ("fairness analysis", "subgroup analysis", "robustness analysis")), F.lit(0))
    return rows.select("path", "workflow", F.size(names).alias("n_models"), F.array_join(F.array_sort(names), ",").alias("models"), blocks.alias("blocks"))


def log_assessment(logs: DataFrame) -> DataFrame:
    """All facts of all logs in long form: ``(path, workflow, section, key, value)``."""
    parsed = parse_logs(logs).persist(StorageLevel.MEMORY_AND_DISK)
    counts = log_counts(parsed)
    parts = [("log", counts.select("path", "workflow", "n_lines", "n_chars", "warnings", "failed", "n_durations", "last_seconds", "html", "json", "markdown")),
             ("training", training_facts(parsed, ["workflow"])), ("compare", compare_facts(parsed).withColumn("workflow", F.lit("compare"))),
             ("eda", eda_facts(parsed)), ("profile", profile_facts(parsed)), ("advanced", advanced_facts(parsed))]
    long = []
    for section, table in parts:
        names = [c for c in table.columns if c not in ("path", "workflow")]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in names]))
        long.append(table.select("path", "workflow", F.lit(section).alias("section"), pairs.alias("p")).select("path", "workflow", "section", "p.key", "p.value"))
    return reduce(DataFrame.unionByName, long).filter(F.col("value").isNotNull())
