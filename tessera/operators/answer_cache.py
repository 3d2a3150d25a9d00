"""The semantic answer cache as a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import routing, text as X


def recent(cache: DataFrame, knowledge_hash: str, most: int = 1000) -> DataFrame:
    """The newest rows of a state of knowledge; the limit is the feature."""
    return cache.where(F.col("knowledge_hash") == knowledge_hash).orderBy(F.desc("id")).limit(most)


def lookup(cache: DataFrame, queries: DataFrame, knowledge_hash: str, threshold: float = 0.93, most: int = 1000, k: int = 5) -> DataFrame:
    """queries(query_id, embedding, presentation_intent): query_id, id, score, rank of the k nearest of the newest rows with
    the same presentation, where the best reaches the threshold.

    The newest rows, `most` at most, go to the executors; a batch of queries is one matrix product and ranked where it is,
    so nothing is shuffled. Null vectors and rows find nothing.
    """
    rows = [r for r in recent(cache, knowledge_hash, most).select("id", "embedding", "presentation_intent").collect() if r[1] is not None and r[2] is not None]
    ids = np.array([r[0] for r in rows], np.int64)
    v = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
    norm = np.linalg.norm(v, axis=1)
    v = v / np.where(norm > 0, norm, 1)[:, None]
    by = {p: np.flatnonzero([r[2] == p for r in rows]) for p in {r[2] for r in rows}}
    kind = dict(queries.dtypes)["query_id"]

    def run(batches):
        for b in batches:
            b = b.filter(pc.and_(b.column("embedding").is_valid(), b.column("presentation_intent").is_valid()))
            wanted = np.array(b.column("presentation_intent").to_pylist(), object)
            for p, own in by.items():
                at = np.flatnonzero(wanted == p)
                if not len(at):
                    continue
                q = np.array(b.column("embedding").take(pa.array(at)).to_pylist(), np.float64)
                size = np.linalg.norm(q, axis=1)
                score = (q / np.where(size > 0, size, 1)[:, None] @ v[own].T).round(6)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # rows come newest first
                top = np.take_along_axis(score, best, 1)
                good = top[:, 0] >= threshold
                n = best.shape[1]
                yield pa.record_batch([b.column("query_id").take(pa.array(np.repeat(at[good], n))), pa.array(ids[own[best[good].ravel()]]), pa.array(top[good].ravel()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), int(good.sum())))], ["query_id", "id", "score", "rank"])

    return queries.select("query_id", "embedding", "presentation_intent").mapInArrow(run, f"query_id {kind}, id long, score double, rank int")


def admit(answers: DataFrame) -> DataFrame:
    """Rows worth keeping, with their cache query and key."""
    q = routing.cache_query(F.col("retrieval_query"), F.col("presentation_intent"), F.col("user_intent"))
    return answers.where(routing.admissible(F.col("answer"))).withColumn("cache_query", q).withColumn("cache_key", routing.cache_key(q))


def source_nodes(nodes: DataFrame) -> DataFrame:
    """query_id, source_nodes: what an answer cites, in order of rank, scores to four digits."""
    item = F.struct("rank", X.rounded(F.col("score"), 4).alias("score"), "file_name", "file_path", "header_path", "line_start", "line_end")
    return nodes.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("rank")).alias("source_nodes"))


def split_stale(cache: DataFrame, knowledge_hash: str) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and how many are stale (one row, column deleted); the caller overwrites the table with the former."""
    fresh = F.col("knowledge_hash").eqNullSafe(knowledge_hash)
    return cache.where(fresh), cache.agg(F.count_if(~fresh).alias("deleted"))


def save(cache: DataFrame, path: str) -> None:
    cache.write.mode("append").parquet(path)
