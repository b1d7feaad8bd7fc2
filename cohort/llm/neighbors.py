"""Approximate nearest neighbours with a permutation index.

A bounded sample of vectors serves as pivots. Every vector is represented by the order in
which it sees its nearest pivots and is posted, with the place of the pivot in that order, in
each of these pivots' inverted files. A query reads the files of its own nearest pivots and
ranks by Spearman's footrule between the orders (a pivot that is missing counts as the place
behind the last); the nearest by footrule are then reranked by the cosine of the vectors.

The index is cut into shards. A shard ranks and reranks its own share for a block of queries
and hands on only the best few, so rows between the stages grow with queries times tasks, never
with pairs. Queries travel in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohort.llm.text import kept, read_table

PIVOTS = 256
PREFIX = 128
#: Pivots are drawn from about this many vectors, chosen by the hash of their content.
SAMPLE = 8192
#: Share of a shard that is reranked, and the least number.
RERANKED = 0.10
LEAST = 512
SHARD = 4096
QUERY_BLOCK = 2048


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, vec)`` of the rows that take part: a key, finite components, not all zero, and the commonest length."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec")).filter("key is not null and vec is not null")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.filter(~bad & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.filter(F.size("vec") == (size["size"] if size else 0))


def choose_pivots(rows: DataFrame, number: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Distinct unit vectors, the first by the hash of their content; copies of a vector count once."""
    count = rows.count()
    share = F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < (1_000_000 if count <= sample else max(1, int(1_000_000 * sample / count)))
    drawn = rows.filter(share).select("vec").distinct().orderBy(F.xxhash64("vec")).limit(number).toPandas()
    if not len(drawn):
        return np.zeros((0, 0))
    found = np.stack(drawn["vec"].to_numpy()).astype(np.float64)
    return found / np.linalg.norm(found, axis=1)[:, None]


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; ties go to the pivot chosen first."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def inverted(order: np.ndarray, pivots: int) -> np.ndarray:
    """The inverted files (pivots x vectors): a pivot's place in each vector's order, the prefix length if it is missing."""
    prefix = order.shape[1]
    files = np.full((pivots, len(order)), prefix, np.int16)
    files[order.astype(np.int64), np.arange(len(order))[:, None]] = np.arange(prefix, dtype=np.int16)
    return files


def build_index(rows: DataFrame, pivots: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """``(key, vec, order)`` of every row, written once."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = np.array(batch.column(1).flatten().to_numpy()).reshape(batch.num_rows, -1)
                order = orders(vectors, sent.value, prefix)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o.tobytes() for o in order], pa.binary())], names=["key", "vec", "order"])

    return kept(rows.mapInArrow(work, "key long, vec array<double>, order binary"), "index")


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    frame = frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return frame[frame.groupby("query_id").cumcount() < k]


def search_shard(ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, queries: tuple, pivots: int, k: int, share: float) -> pd.DataFrame:
    """The ``k`` best of one shard for every query of a block."""
    names, wanted, wanted_order = queries
    files, norms, prefix = inverted(order, pivots), np.sqrt((vectors * vectors).sum(axis=1)), order.shape[1]
    places = np.arange(prefix, dtype=np.int16)[:, None]
    take = min(len(ids), max(LEAST, int(np.ceil(share * len(ids)))))
    out = []
    for name, query, own in zip(names, wanted, wanted_order.astype(np.int64)):
        footrule = np.abs(files[own] - places[: len(own)]).sum(axis=0, dtype=np.int32)
        near = np.argpartition(footrule, take - 1)[:take] if take < len(ids) else np.arange(len(ids))
        near = near[ids[near] != name]
        score = (vectors[near] * query).sum(axis=1) / (norms[near] * np.sqrt((query * query).sum()))
        first = np.lexsort((ids[near], -score))[:k]
        out.append(pd.DataFrame({"query_id": name, "vec_id": ids[near][first], "score": score[first]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


def search(index: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int = 5, prefix: int = PREFIX, share: float = RERANKED, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found among all rows of the index but those of the query's key."""
    spark = index.sparkSession
    queries = queries.select("key", "vec").distinct()
    blocks = max(1, -(-queries.count() // block))
    part, found = F.pmod(F.xxhash64("key", "vec"), F.lit(blocks)), None
    for number in range(blocks):  # one bounded block of queries at a time
        own = queries.filter(part == number).orderBy("key").toPandas()
        if not len(own):
            continue
        wanted = np.stack(own["vec"].to_numpy()).astype(np.float64)
        sent = spark.sparkContext.broadcast((own["key"].to_numpy(np.int64), wanted, orders(wanted, pivots, prefix)))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = []
            for batch in batches:
                for start in range(0, batch.num_rows, SHARD):
                    shard = batch.slice(start, SHARD)
                    vectors = np.array(shard.column(1).flatten().to_numpy()).reshape(shard.num_rows, -1)
                    order = np.frombuffer(b"".join(shard.column(2).to_pylist()), np.int16).reshape(shard.num_rows, -1)
                    best.append(search_shard(shard.column(0).to_numpy(), vectors, order, sent.value, len(pivots), k, share))
                    best = [_best(pd.concat(best), k)]
            if best:
                yield from pa.Table.from_pandas(best[0], preserve_index=False).to_batches()

        near = index.mapInArrow(work, "query_id long, vec_id long, score double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return placed.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame | None = None, key: str = "vec_id", vector: str = "embedding", k: int = 5, n_pivots: int = PIVOTS, prefix: int = PREFIX, share: float = RERANKED) -> DataFrame:
    """Nearest rows by cosine for every query (every usable row, if none are given).

    Rows whose vector is null, zero, holds null or non-finite components or has another length than
    most take no part, nor do rows without a key. Ties go to the smaller key. Rows that repeat a key
    are candidates for others, each for itself, and never for that key; queries of one key are one.
    """
    rows = kept(usable(vectors, key, vector), "vectors")
    pivots = choose_pivots(rows, n_pivots)
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows if queries is None else rows.join(queries.select(F.col(key).cast("long").alias("key")).distinct(), "key", "left_semi")
    return search(build_index(rows, pivots, min(prefix, len(pivots))), asked, pivots, k, min(prefix, len(pivots)), share)


def op10_ann_permutation_index(spark, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))
