"""Save, load and apply a chosen model."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohort.functions.columns import column, require
from cohort.operators.gam import GamModel
from cohort.operators.models import Design, FittedModel, fit_model
from cohort.roles import ColumnRoles
from cohort.sources.tables import read_document, read_json, read_csv, write_csv, write_document, write_json

# Fixed value: the note every scored row carries.
DISCLAIMER = (
    "This model is a screening support tool for research/education. "
    "It is not a clinical diagnosis and must not replace professional assessment."
)
LOADERS = {"logistic": LogisticRegressionModel, "boosted": GBTClassificationModel, "perceptron": MultilayerPerceptronClassificationModel}


@dataclass
class Deployment:
    model: FittedModel
    threshold: float = 0.5
    policy: str = "screening"
    profile: str = "safe"
    metadata: dict = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        roles = self.model.roles
        return [*roles.numeric, *roles.ordinal, *roles.nominal]

    def predict(self, df: DataFrame) -> DataFrame:
        """Probability, decision at the stored threshold, label and provenance per row."""
        require(df, self.columns, "prediction input")
        roles = self.model.roles
        shaped = df.select(
            *[c for c in [column(roles.row_id)] if roles.row_id in df.columns],
            *[column(c).cast("string").try_cast("double").alias(c) for c in [*roles.numeric, *roles.ordinal]],
            *[column(c).cast("string").alias(c) for c in roles.nominal],
        )
        return decision_columns(self.model.score(shaped), roles.row_id, self)


def decision_columns(scored: DataFrame, key: str, deployment: Deployment) -> DataFrame:
    flag = F.col("y_score") >= F.lit(float(deployment.threshold))
    keep = [column(key)] if key in scored.columns else []
    return scored.select(
        *keep, F.round("y_score", 6).alias("probability"), flag.cast("int").alias("prediction"),
        F.when(flag, "screening_flag").otherwise("not_flagged").alias("risk_label"),
        F.lit(round(float(deployment.threshold), 6)).alias("threshold"), F.lit(deployment.policy).alias("threshold_policy"),
        F.lit(deployment.model.name).alias("model"), F.lit(deployment.profile).alias("profile"), F.lit(DISCLAIMER).alias("disclaimer"))


def fit_deployment(
    df: DataFrame, roles: ColumnRoles, name: str, profile: str = "safe", threshold: float = 0.5, policy: str = "screening", **params
) -> Deployment:
    """Final fit on every row of the chosen profile."""
    model = fit_model(name, df, roles.for_profile(profile).present(df), **params)
    stats = df.agg(F.count(F.lit(1)).alias("rows"), F.avg(column(roles.target).cast("double")).alias("rate")).first()
    return Deployment(model, threshold, policy, profile, {"rows": stats["rows"], "positive_rate": stats["rate"], "params": params})


def save_deployment(spark: SparkSession, deployment: Deployment, path: str) -> None:
    """Pipeline and model folders plus one JSON document with columns, threshold and statistics."""
    model = deployment.model
    document = {
        "model": model.name, "threshold": deployment.threshold, "policy": deployment.policy, "profile": deployment.profile,
        "columns": deployment.columns, "roles": asdict(model.roles), "metadata": deployment.metadata,
    }
    if model.name == "gam":
        document["gam"] = model.model.to_json()
    else:
        model.design.pipeline.write().overwrite().save(f"{path}/design")
        model.model.write().overwrite().save(f"{path}/model")
        document["feature_names"], document["max_levels"] = model.design.feature_names, model.design.max_levels
    write_document(spark, document, f"{path}/metadata")


def load_deployment(spark: SparkSession, path: str) -> Deployment:
    doc = read_document(spark, f"{path}/metadata")
    roles = ColumnRoles(**doc["roles"])
    if doc["model"] == "gam":
        model = FittedModel("gam", None, GamModel.from_json(doc["gam"]), roles)
    else:
        design = Design(PipelineModel.load(f"{path}/design"), doc["feature_names"], roles, doc["max_levels"])
        model = FittedModel(doc["model"], design, LOADERS[doc["model"]].load(f"{path}/model"), roles)
    return Deployment(model, doc["threshold"], doc["policy"], doc["profile"], doc["metadata"])


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Prediction input: CSV, or JSON (an array, or one object per line)."""
    if path.rstrip("/").endswith(".json"):
        head = spark.read.text(path).filter(F.trim("value") != "").first()
        line = head["value"].strip() if head else ""
        return read_json(spark, path, schema, multi_line=not (line.startswith("{") and line.endswith("}")))
    return read_csv(spark, path, schema)


def predict_file(spark: SparkSession, deployment: Deployment, source: str, target: str, schema: str | None = None) -> None:
    """Score a file and write the result as CSV or JSON by the target's suffix."""
    scored = deployment.predict(read_records(spark, source, schema))
    (write_json if target.rstrip("/").endswith(".json") else write_csv)(scored, target)
