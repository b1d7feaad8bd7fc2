"""Dense algebra on matrices the size of the column list.

The work runs inside one Spark task, where a single BLAS thread is set up, rather than in
the driver process: forking and a threaded BLAS in a driver can deadlock.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession


def in_task(spark: SparkSession, fn: Callable, *args):
    """``fn(*args)`` evaluated in a task; arguments and result are small arrays."""

    def run(batches):
        for frame in batches:
            out = [pickle.dumps(fn(*pickle.loads(bytes(b)))) for b in frame["blob"]]
            yield pd.DataFrame({"blob": out})

    one = spark.createDataFrame([(bytearray(pickle.dumps(args)),)], "blob binary")
    return pickle.loads(bytes(one.mapInPandas(run, "blob binary").first()["blob"]))
