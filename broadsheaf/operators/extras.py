"""Vector neighbours, crowd answers, calibration and version differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Vectors in a piece, voters that one task meets, rows of a piece that are scored at a time, groups of voters whose best give a first
#: bound, and pairs whose exact similarity is summed at a time.
PIECE, SPAN, TILE, GROUPS, PAIRS = 16384, 524_288, 512, 128, 1 << 16
#: Stands for a null class or page.
NONE = -(2**63)


def unit(v: Column) -> Column:
    """A vector of length one; zero vectors stay."""
    x = F.transform(v, lambda a: a.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a))
    return F.transform(F.array(norm), lambda n: F.transform(x, lambda a: F.when(n > 0, a / n).otherwise(a)))[0]


def knn_agreement(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", class_col: str = "label", page: Column | None = None) -> DataFrame:
    """For each vector the similarity-weighted share of its k nearest others (positive cosine, another page) of its class.

    All pairs are scored. Pieces of rows meet spans of voters as a product of partitions, which reads what the one shuffle of the
    vectors wrote and writes nothing again; a task keeps its k best, so what is shuffled is k rows per vector and span. Ids and vectors
    that are null, and vectors with null or non-finite components, take no part; shorter vectors count as if padded with zeros.
    """
    from pyspark.sql import Window as W

    page = page if page is not None else F.col(id_col)
    v = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(class_col).cast("int").cast("long").alias("c"), page.cast("long").alias("p"), F.col(vector_col).alias("v"))
    if v.schema["v"].dataType != T.ArrayType(T.FloatType()):
        v = v.withColumn("v", F.col("v").cast("array<double>"))
    n, cores = v.count(), vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // PIECE), min(cores, -(-n // 1024)))
    v = v.repartitionById(parts, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    rows, voters = _pieces(v, None), _pieces(v.coalesce(max(1, -(-n // SPAN))), k)
    pairs = rows.hint("shuffle_replicate_nl").crossJoin(voters.select(*(F.col(x).alias(f"v_{x}") for x in voters.columns)))

    def told(own: tuple, held: tuple) -> pa.RecordBatch:
        i, s, other, c = held
        mine = own[1][i]
        return pa.record_batch([pa.array(own[0][i]), pa.array(mine, mask=mine == NONE), pa.array(s), pa.array(other), pa.array((mine == c) & (c != NONE))], ["id", "c", "s", "other", "same"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, own, held = None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if r["piece"] != piece:
                    if own:
                        yield told(own, held)
                    piece, own = r["piece"], _open(r)
                    held = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
                held = _nearer(own, held, _open(r, "v_"), k)
        if own:
            yield told(own, held)

    best = pairs.mapInArrow(run, "id long, c long, s double, other long, same boolean").withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("s"), "other"))).where(F.col("n") <= k)
    share = (F.sum(F.when(F.col("same"), F.col("s")).otherwise(0.0)) / F.sum("s")).alias("agreement")
    return best.groupBy("id", "c").agg(share).select("id", F.col("c").cast("int").alias("c"), "agreement")


def _pieces(vectors: DataFrame, keep: int | None) -> DataFrame:
    """Vectors of each part packed into pieces; with ``keep`` without copies that can be no one's ``keep`` best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, left = TaskContext.get().partitionId() << 32, []
        for b in batches:
            left.append(b)
            if sum(x.num_rows for x in left) >= PIECE:
                whole = pa.Table.from_batches(left)
                while whole.num_rows >= PIECE:
                    yield packed(whole.slice(0, PIECE), number)
                    whole, number = whole.slice(PIECE), number + 1
                left = whole.to_batches()
        if left:
            yield packed(pa.Table.from_batches(left), number)

    def packed(t: pa.Table, number: int) -> pa.RecordBatch:
        v = t.column("v").combine_chunks()
        lens = pc.list_value_length(v).to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False)
        data = np.zeros((len(lens), int(lens.max(initial=0))), flat.dtype)
        data[np.arange(data.shape[1]) < lens[:, None]] = flat
        ids, c, p = (pc.fill_null(t.column(x), NONE).to_numpy() for x in ("id", "c", "p"))
        some = np.flatnonzero(np.isfinite(data).all(1))
        if keep:
            some = some[_needed(ids[some], p[some], data[some], keep)]
        return pa.record_batch([pa.array([number]), pa.array([data.shape[1]], pa.int32()), *(pa.array([x[some].tobytes()], pa.binary()) for x in (ids, c, p, data))], ["piece", "dims", "ids", "classes", "pages", "data"])

    return vectors.mapInArrow(run, "piece long, dims int, ids binary, classes binary, pages binary, data binary")


def _open(r: dict, head: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, classes, pages and vectors of length one, as ``unit`` makes them."""
    ids, c, p = (np.frombuffer(r[head + x], np.int64) for x in ("ids", "classes", "pages"))
    shape = len(ids), r[head + "dims"]
    data = np.frombuffer(r[head + "data"], np.float32 if len(r[head + "data"]) == 4 * shape[0] * shape[1] else np.float64).reshape(shape).astype(np.float64)
    norm = np.zeros(len(ids))
    for x in data.T:
        norm += x * x
    return ids, c, p, data / np.sqrt(np.where(norm > 0, norm, 1))[:, None]


def _turn(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each row its place among those of equal keys, which lie together in ``order``."""
    begins = np.ones(len(order), bool)
    begins[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    place, out = np.arange(len(order)), np.empty(len(order), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(begins, place, 0))
    return out


def _needed(ids: np.ndarray, pages: np.ndarray, data: np.ndarray, k: int) -> np.ndarray:
    """Places of the voters that can be among a row's k best: of equal vectors the least ids, k of a page and 2 k in all.

    A row leaves out one page, that is k of these at most.
    """
    place = np.arange(len(ids))
    if not data.size:
        return place
    copy = np.unique(np.ascontiguousarray(data).view(np.dtype((np.void, data.itemsize * data.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    if len(ids) == copy.max() + 1:
        return place
    place = place[_turn(np.lexsort((ids, pages, copy)), copy, pages) < k]
    return place[_turn(np.lexsort((ids[place], copy[place])), copy[place]) < 2 * k]


def _nearer(own: tuple, held: tuple, voters: tuple, k: int) -> tuple:
    """The k best of each row out of what it holds and these voters: row, similarity, id and class.

    A product of 32-bit numbers, less than ``slack`` off, finds the pairs that can be among them; their similarities are summed
    anew in the order of the components, so that copies tie.
    """
    (_, _, mine, a), (ids, classes, theirs, b) = own, voters
    dims = max(a.shape[1], b.shape[1])
    if not len(a) or not len(b) or not dims:
        return held
    a, b = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (a, b))
    a32, b32 = a.astype(np.float32), b.astype(np.float32).T
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    slack = (dims + 8) * 2.0**-22
    least = np.zeros(len(mine))  # of each row's k best, where it has k
    last = _turn(np.arange(len(held[0])), held[0]) == k - 1
    least[held[0][last]] = held[1][last]
    by_page = np.argsort(theirs, kind="stable")
    begin, end = (np.searchsorted(theirs[by_page], mine, side) for side in ("left", "right"))
    groups = max(GROUPS, 4 * k)
    deep = len(ids) // groups
    found = [held]
    for x in range(0, len(mine), TILE):
        s = a32[x : x + TILE] @ b32
        times = (end - begin)[x : x + TILE]
        if times.any():
            i = np.repeat(np.arange(len(times)), times)
            s[i, by_page[np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[x : x + TILE], times)]] = -2
        cut = least[x : x + TILE] - slack
        if deep > 1 and not least[x : x + TILE].all():
            tops = s[:, : deep * groups].reshape(len(s), deep, groups).max(1)
            cut = np.maximum(cut, np.partition(tops, groups - k, axis=1)[:, groups - k] - 2 * slack)
        some = _set(s >= cut.astype(np.float32)[:, None])
        parts = []
        for y in range(0, len(some), PAIRS):
            i, j = np.divmod(some[y : y + PAIRS], len(ids))
            i += x
            exact = np.zeros(len(i))
            for p, q in zip(a, b):
                exact += p[i] * q[j]
            able = (exact > 0) & (exact >= least[i])
            parts.append((i[able], exact[able], ids[j[able]], classes[j[able]]))
        if parts:
            found.append(_first(parts, k))
    return _first(found, k) if len(found) > 1 else held


def _first(parts: list[tuple], k: int) -> tuple:
    """By row the k best by similarity, then smaller id, in this order."""
    i, s, ids, c = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, -s, i))
    order = order[_turn(order, i)[order] < k]
    return i[order], s[order], ids[order], c[order]


def _set(where: np.ndarray) -> np.ndarray:
    """Places of the few that are true, eight looked at together."""
    flat = where.ravel()
    whole = len(flat) // 8 * 8
    eight = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (eight[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


CHOICES = ("a", "b", "neither", "unsure", "notext")


def settle(answers: DataFrame, task: str, choice: str, least: int = 3, most: int = 7) -> DataFrame:
    """Counts by choice, and the state: settled by two thirds of three answers or more, disputed at seven."""
    g = answers.groupBy(task).agg(F.count("*").alias("n"), *(F.count_if(F.col(choice) == c).alias(f"n_{c}") for c in CHOICES))
    top = F.greatest(*(F.col(f"n_{c}") for c in CHOICES))
    first = F.coalesce(*(F.when(F.col(f"n_{c}") == top, F.lit(c)) for c in CHOICES))
    won = (F.col("n") >= least) & (3 * top >= 2 * F.col("n"))
    return g.withColumn("state", F.when(won, "settled").when(F.col("n") >= most, "disputed").otherwise("open")).withColumn("winner", F.when(won, first))


def calibration(pairs: DataFrame, reader: str, true: str, estimate: str) -> DataFrame:
    """By reader: means, bias, absolute error, linear and rank correlation of an estimate."""
    from pyspark.sql import Window as W

    w = W.partitionBy(reader)
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(W.partitionBy(reader, c)) - 1) / F.lit(2.0)
    r = pairs.withColumn("__t", rank(true)).withColumn("__e", rank(estimate))
    t, e = F.col(true), F.col(estimate)
    return r.groupBy(reader).agg(F.count("*").alias("n"), F.avg(t).alias("true_mean"), F.avg(e).alias("estimate_mean"), F.avg(e - t).alias("bias"), F.avg(F.abs(e - t)).alias("mae"), F.corr(true, estimate).alias("pearson"), F.corr("__t", "__e").alias("spearman"))


def version_diff(a: DataFrame, b: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Values of two versions side by side, with changes above the threshold flagged."""
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
    change = F.when(F.col("a") > 0, 100.0 * (F.col("b") - F.col("a")) / F.col("a"))
    return j.withColumn("change", change).withColumn("flagged", F.coalesce(F.abs(change) > threshold, F.lit(True)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def hourly(rows: DataFrame, begin: str, end: str, value: str) -> DataFrame:
    """An interval's value spread over the hours it covers, by seconds."""
    h = rows.withColumn("hour", F.explode(F.sequence(F.date_trunc("hour", begin), F.date_trunc("hour", end), F.expr("interval 1 hour"))))
    seconds = F.greatest(F.unix_timestamp(F.least(F.col(end), F.col("hour") + F.expr("interval 1 hour"))) - F.unix_timestamp(F.greatest(F.col(begin), F.col("hour"))), F.lit(0))
    whole = F.unix_timestamp(end) - F.unix_timestamp(begin)
    return h.groupBy("hour").agg(F.sum(F.col(value) * seconds / whole).alias(value), F.sum(seconds).alias("seconds"))
