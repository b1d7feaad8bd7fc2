"""Scoring a stream with a saved model; no state, every row on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohort.plans.deploy import Deployment
from cohort.streaming.trend import run_to_parquet


def score_stream(stream: DataFrame, deployment: Deployment) -> DataFrame:
    return deployment.predict(stream)


def score_to_parquet(stream: DataFrame, deployment: Deployment, path: str, checkpoint: str, timeout: int | None = None) -> None:
    run_to_parquet(score_stream(stream, deployment), path, checkpoint, timeout=timeout)
