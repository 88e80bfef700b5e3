"""Exact top-k inner-product search by three phases with a uniform threshold.

The components are dealt to ``lists`` blocks, as to the nodes of a distributed top-k query; a vector's score is the sum of its
scores over the blocks. Queries and candidates are cut into chunks, and each task takes one chunk of both.

1. *Gather*: the first block alone scores all vectors of a chunk, and of its k best per query the full scores are looked up.
   The k best of these over all chunks give a lower bound t of the k-th best score of each query.
2. *Cutoff*: t is sent to all chunks. What the blocks not yet known can add is at most the product of the lengths of their parts
   of both vectors, so an entry whose known scores and that bound do not reach t cannot be among the best and is let go.
3. *Resolve*: the other blocks score what is left, with the cutoff applied again after each, and the k best per query are kept.

All arithmetic is exact: components are whole numbers, sums that could leave 2^53 use 64-bit integers.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; shorter vectors count
as if padded with zeros; of identical vectors in a chunk only the k + 1 with the smallest ids can be among the
best and go on; equal scores go to the smaller id; null ids take no part; rows with repeated ids are queries and candidates of
their own, and only a query's own row is no candidate for it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise, tune

#: Vectors in a chunk of candidates, and in a chunk of queries.
CHUNK, QUERY_CHUNK = 4096, 512
EXACT = 2**53


def _matrix(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), dtype=np.int64)
    for i, r in enumerate(rows):
        v = np.frombuffer(r, dtype="<i8")
        out[i, : len(v)] = v
    return out


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole-number inner products of all rows of q and v, in their type."""
    return q @ v.T


def _exact(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floating-point numbers where all sums of products are exact, else as 64-bit integers."""
    if q.size and v.size and float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < EXACT:
        return q.astype(np.float64), v.astype(np.float64)
    return q, v


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id and packed whole-number components floor(scale * x) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, data = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or v is None or any(x is None for x in v):
                    continue
                x = np.asarray(v, dtype=np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    data.append(np.floor(scale * x).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["vec_id", "v"])

    tune(vectors.sparkSession)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v binary")


def _chunks(rows: DataFrame, size: int, keep: int | None) -> tuple[DataFrame, int]:
    """Rows of ids and packed vectors, dealt into chunks of about ``size``, and how many chunks.

    With ``keep``, of identical vectors in a chunk only those with the smallest ``keep`` ids stay.
    """
    n = rows.count()
    parts = max(1, -(-n // size))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"], kind="stable")
        if keep:
            pdf = pdf[pdf.groupby("v").cumcount() < keep]
        lens = pdf["v"].map(len).to_numpy(dtype="<i4")
        return pd.DataFrame({"chunk": [key[0]], "n": [len(pdf)], "ids": [pdf["vec_id"].to_numpy(dtype="<i8").tobytes()], "rows": [pdf["row"].to_numpy(dtype="<i8").tobytes()], "lens": [lens.tobytes()], "data": [b"".join(pdf["v"])]})

    dealt = rows.withColumn("chunk", _chunk(parts))
    return dealt.groupBy("chunk").applyInPandas(run, "chunk int, n int, ids binary, rows binary, lens binary, data binary"), parts


def _chunk(parts: int):
    return F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")


def _open(r: dict, head: str = "") -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ends = np.cumsum(np.frombuffer(r[head + "lens"], dtype="<i4"))
    data = r[head + "data"]
    return np.frombuffer(r[head + "ids"], dtype="<i8"), np.frombuffer(r[head + "rows"], dtype="<i8"), [data[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]


def _pairs(queries: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """Each chunk of queries (0 .. n - 1) with each chunk of candidates: a stated query set against all rows, in blocks."""
    c = candidates.select(F.col("chunk").alias("c_chunk"), *(F.col(x).alias(f"c_{x}") for x in ("ids", "rows", "lens", "data")), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk"))
    return c.join(queries.hint("shuffle_hash"), "chunk").withColumnRenamed("chunk", "q_chunk").repartition(F.col("q_chunk"), F.col("c_chunk"))


def _blocks(dims: int, lists: int) -> list[slice]:
    edges = np.linspace(0, dims, min(lists, max(dims, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _better(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _lengths(m: np.ndarray, blocks: list[slice]) -> np.ndarray:
    """For each row the length of its part in the blocks after each (blocks, rows)."""
    squares = [np.square(m[:, s].astype(np.float64)).sum(axis=1) for s in blocks[1:]]
    return np.sqrt(np.cumsum([np.zeros(len(m)), *squares[::-1]], axis=0)[::-1])


def _resolved(q: np.ndarray, v: np.ndarray, blocks: list[slice], known: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and full score of the entries that can reach the queries' bounds ``t`` (-inf: none is let go)."""
    left_q, left_v = _lengths(q, blocks), _lengths(v, blocks)
    # what floating point may lose: of scores, of lengths and of the bounds
    t = t - 1 - 1e-9 * (np.abs(np.where(np.isfinite(t), t, 0)) + np.linalg.norm(q.astype(np.float64), axis=1) * np.linalg.norm(v.astype(np.float64), axis=1).max(initial=0))
    score, j = known, 0
    while True:  # whole rows, as long as many are left
        able = score + np.outer(left_q[j], left_v[j]) >= t[:, None]
        j += 1
        if j == len(blocks) or 4 * np.count_nonzero(able) <= able.size:
            break
        score = score + _product(q[:, blocks[j]], v[:, blocks[j]])
    qi, vi = np.nonzero(able)
    score = score[qi, vi]
    for s, more_q, more_v in zip(blocks[j:], left_q[j:], left_v[j:]):  # then only what is left
        cut = np.searchsorted(qi, np.arange(len(q) + 1)).tolist()
        score = score + np.concatenate([_product(q[i : i + 1, s], v[vi[a:b], s])[0] for i, (a, b) in enumerate(zip(cut, cut[1:]))] or [score[:0]])
        some = score + more_q[qi] * more_v[vi] >= t[qi]
        qi, vi, score = qi[some], vi[some], score[some]
    return qi, vi, score.astype(np.int64)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, lists: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row with id divisible by ``every`` the k best other rows."""
    # a number for each row, written, so that it stays
    rows = materialise(whole(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "whole")
    candidates = materialise(_chunks(rows, CHUNK, k + 1)[0], "candidates")
    asked = rows.where(F.col("vec_id") % every == 0)
    queries, parts = _chunks(asked, QUERY_CHUNK, None)
    queries = materialise(queries, "queries")
    shape = "row long, query_id long, vec_id long, score long"

    def each(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                q_id, q_row, q = _open(r)
                c_id, c_row, c = _open(r, "c_")
                dims = max((len(x) // 8 for x in (*q, *c)), default=0)
                blocks = _blocks(dims, lists)
                q, c = _exact(_matrix(q, dims), _matrix(c, dims))
                yield r, q_id, q_row, q, c_id, c_row, c, blocks, _product(q[:, blocks[0]], c[:, blocks[0]])

    def told(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["row", "query_id", "vec_id", "score"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q_id, q_row, q, c_id, c_row, c, _, known in each(batches):
            out = []
            for i, own in enumerate(q_row):
                some = _better(known[i], c_id, k + 1)
                some = some[c_row[some] != own]
                out.append((np.full(len(some), own), np.full(len(some), q_id[i]), c_id[some], _product(q[i : i + 1], c[some])[0].astype(np.int64)))
            yield from told(out)

    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    pairs = _pairs(queries, candidates, parts)
    first = pairs.mapInArrow(gather, shape).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    bound = first.groupBy("row").agg(F.min("score").alias("t"), F.count("*").alias("n"))
    # a query with fewer than k entries has no lower bound: everything must be handed over
    bound = bound.select("row", F.when(F.col("n") >= k, F.col("t")).alias("t"))
    held = asked.select("row", _chunk(parts).alias("q_chunk")).join(bound, "row", "left")
    cut = held.groupBy("q_chunk").agg(F.collect_list(F.struct("row", "t")).alias("bounds"))  # a chunk of queries

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, q_id, q_row, q, c_id, c_row, c, blocks, known in each(batches):
            bounds = {x["row"]: x["t"] for x in r["bounds"]}
            t = np.array([-np.inf if bounds.get(x) is None else float(bounds[x]) for x in q_row.tolist()])
            qi, vi, score = _resolved(q, c, blocks, known, t)
            other = c_row[vi] != q_row[qi]
            qi, vi, score = qi[other], vi[other], score[other]
            at = np.searchsorted(qi, np.arange(len(q) + 1))
            out = []
            for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                keep = a + _better(score[a:b], c_id[vi[a:b]], k)
                out.append((np.full(len(keep), q_row[i]), np.full(len(keep), q_id[i]), c_id[vi[keep]], score[keep]))
            yield from told(out)

    second = _pairs(queries, candidates, parts).join(cut.hint("shuffle_hash"), "q_chunk")
    found = second.mapInArrow(resolve, shape)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
