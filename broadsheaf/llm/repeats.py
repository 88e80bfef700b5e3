"""Removal of long repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

*What must be compared.* Every string of ``length`` bytes has an anchor: the least hash among its runs of ``gram``
bytes, the leftmost on ties. The anchor depends on the string's content only, so equal strings have equal anchors at
equal offsets. All strings that start one after the other and have one anchor are a region (from the first start to
the last end). Regions of one anchor hash are compared with each other and with nothing else; a hash that occurs
once needs no comparison. Equal regions are one class with a count.

*Comparison.* A task concatenates the classes of its hashes, sorts their suffixes up to ``length`` symbols (prefix
doubling over whole arrays) and takes the Burrows-Wheeler transform. Common-prefix values are then derived in
increasing order: boundaries with value l, expanded backward by each symbol in their interval, give boundaries with
value l + 1 through the LF mapping. The expansion is breadth-first, a level at a time, and stops at ``length``:
suffixes between which no boundary was set share ``length`` bytes or more. Strings whose interval holds two
occurrences are repeated.

*Hot hashes.* A hash with more classes than a task takes is dealt over several tasks. These also hand over each
distinct string they hold, as a 128-bit hash with its count, and counts are summed up over the tasks, so nothing is
missed and no task ever holds all of a hot group.

*Copies.* Equal texts are one node with a count (128-bit hash); with two rows or more every byte of a long enough text
is covered.

Defined cases: null texts are empty; texts shorter than ``length`` bytes keep all bytes; repeated rows are copies of
each other; an empty table gives an empty result; other columns are not read. Removed bytes may split characters, so
what is left is hashed as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_dealt, materialise, mix64, ranges, row_key, slices, spans, texts, tune

LENGTH, GRAM = 400, 100
#: Windows that are anchored at a time.
STEP = 1 << 20
#: Classes of one hash that one task takes, and bytes that are transformed at a time.
GROUP_CLASSES, TASK_BYTES = 4096, 1 << 20
BASE = 0x9E3779B97F4A7C15
POSITION = np.uint64((1 << 24) - 1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (modulo 2^64)."""
    size = 1 << max(n - 1, 1).bit_length()
    if size not in _tables:
        _tables.clear()
        up = np.cumprod(np.append(np.uint64(1), np.full(size - 1, BASE, dtype=np.uint64)))
        down = np.cumprod(np.append(np.uint64(1), np.full(size - 1, pow(BASE, -1, 1 << 64), dtype=np.uint64)))
        _tables[size] = (up, down)
    return _tables[size]


class Hasher:
    """Hashes of any substrings of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    n = len(keys) - width + 1
    pad = -len(keys) % width
    rows = np.append(keys, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def regions(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Regions of texts that lie one after the other: text, first start, starts, anchor hash, region hash."""
    out: list[tuple[np.ndarray, ...]] = []
    if len(data) >= length:
        end_of = bounds[1:]
        for s in range(0, len(data) - length + 1, STEP):
            part = data[s : s + STEP + length - 1]
            h = Hasher(part)
            at = np.arange(len(part) - gram + 1)
            grams = mix64(h(at, at + gram))
            best = (_least(grams & ~POSITION | at.astype(np.uint64), length - gram + 1) & POSITION).astype(np.int64)
            start = np.arange(len(best)) + s
            text = np.searchsorted(end_of, start, side="right")
            valid = start + length <= end_of[np.minimum(text, len(end_of) - 1)]
            fresh = np.append(True, (best[1:] != best[:-1]) | ~valid[:-1]) & valid
            first = np.flatnonzero(fresh)
            stop = np.append(True, (best[1:] != best[:-1]) | ~valid[1:])
            stop = np.append(stop[1:], True) & valid
            last = np.flatnonzero(stop)
            anchor = grams[best[first]]
            whole = mix64(h(first, last + length) + (best[first] - first).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) ^ mix64((last - first).astype(np.uint64))
            t = text[first]
            out.append((t, first + s - bounds[t], last - first + 1, anchor.astype(np.int64), whole.astype(np.int64)))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def suffixes(sym: np.ndarray, depth: int, base: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in order of their first ``depth`` symbols (ties by place), the sorted first keys, and the symbols in a key."""
    n = len(sym)
    k = 1
    while base ** (k + 1) < 1 << 62:
        k += 1
    pad = np.append(sym.astype(np.int64), np.zeros(k, np.int64))
    key = np.zeros(n, dtype=np.int64)
    for j in range(k):
        key = key * base + pad[j : j + n]
    sa = np.argsort(key, kind="stable")
    sorted_keys = key[sa]
    head = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
    where = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + depth + 1, dtype=np.int64)
    rank[n:] = -1
    rank[sa] = where
    done = k
    open_ = np.flatnonzero(~head | ~np.append(head[1:], True))
    while done < depth and len(open_):
        idx = sa[open_]
        both = rank[idx] * np.int64(n + 1) + rank[np.minimum(idx + done, n)] + 1
        o = np.argsort(both, kind="stable")
        both, idx = both[o], idx[o]
        sa[open_] = idx
        head = np.append(True, both[1:] != both[:-1])
        rank[idx] = np.maximum.accumulate(np.where(head, open_, 0))
        open_ = open_[~head | ~np.append(head[1:], True)]
        done *= 2
    return sa, sorted_keys, k


def intervals(sym: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and, for each, the number of its interval of suffixes that share ``length`` symbols."""
    n = len(sym)
    _, sym = np.unique(sym, return_inverse=True)  # a dense alphabet: longer keys
    base = int(sym.max()) + 2
    sa, keys, k = suffixes(sym + 1, length, base)
    bwt = sym[sa - 1].astype(np.uint16)
    order = np.argsort(bwt, kind="stable")
    lf = np.empty(n, dtype=np.int64)
    lf[order] = np.arange(n)
    prev = np.full(n, -1, dtype=np.int64)
    same = bwt[order[1:]] == bwt[order[:-1]]
    prev[order[1:][same]] = order[:-1][same]
    # values below the symbols of a key are read off the keys
    bound = np.zeros(n + 1, dtype=bool)
    bound[0] = bound[n] = True
    new = np.zeros(0, dtype=np.int64)
    top = min(k, length)
    for level in range(top):
        cut = np.int64(base) ** (k - 1 - level)
        differs = np.flatnonzero(keys[1:] // cut != keys[:-1] // cut) + 1
        new = differs[~bound[differs]]
        bound[new] = True
    for _ in range(top, length):
        if not len(new):
            break
        # the end of the interval that begins at each new boundary
        stop = np.zeros(len(new), dtype=np.int64)
        todo, off, width = np.arange(len(new)), 1, 4
        while len(todo):
            look = bound[np.minimum(new[todo][:, None] + np.arange(off, off + width), n)]
            found = look.any(axis=1)
            stop[todo[found]] = new[todo[found]] + off + look[found].argmax(axis=1)
            todo = todo[~found]
            off += width
            width = min(width * 4, 4096)
        size = stop - new
        j = ranges(new, size)
        j = j[prev[j] < np.repeat(new, size)]  # the first of its symbol in the interval
        t = lf[j]
        new = np.unique(t[~bound[t]])
        bound[new] = True
    return sa, np.cumsum(bound[:n]) - 1


def repeated_starts(parts: list[np.ndarray], counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of classes of regions: for each start of a string its class, its offset, the string's number and how often it occurs."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    at = spans(size + 1)
    sym = np.zeros(int(at[-1]), dtype=np.uint16)
    sym[ranges(at[:-1], size)] = np.concatenate(parts).astype(np.uint16) + 1
    sa, group = intervals(sym, length)
    starts = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(parts)), starts)
    offset = ranges(np.zeros(len(parts), np.int64), starts)
    of_place = np.empty(len(sym), dtype=np.int64)
    of_place[sa] = group
    mine = of_place[at[:-1][owner] + offset]
    times = np.bincount(mine, counts[owner], minlength=int(group[-1]) + 1 if len(group) else 0).astype(np.int64)
    return owner, offset, mine, times


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of set flags within one owner."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on
    cut = np.append(True, (np.diff(on) != 1) | (owner[on[1:]] != owner[on[:-1]]))
    return on[cut], on[np.append(cut[1:], True)]


def _compare(classes: DataFrame, length: int) -> DataFrame:
    """Rows of kind 0: runs of repeated starts of a class; of kind 1: distinct strings of hashes that are split."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(r[4], dtype=np.uint8) for r in rows]
        counts = np.array([r[3] for r in rows], dtype=np.int64)
        split = np.array([r[2] > 1 for r in rows])
        h, r = (np.array([x[i] for x in rows], dtype=np.int64) for i in (0, 1))
        owner, offset, mine, times = repeated_starts(parts, counts, length)
        a, b = _runs(times[mine] > 1, owner)
        cols = [[np.zeros(len(a), np.int64), h[owner[a]], r[owner[a]], offset[a], offset[b], *(np.zeros(len(a), np.int64) for _ in range(3))]]
        some = np.flatnonzero(split[owner])
        if len(some):
            _, first = np.unique(mine[some], return_index=True)
            some = some[first]
            lone = owner[some]
            size = np.array([len(p) for p in parts], dtype=np.int64)
            at = spans(size)
            data = np.concatenate(parts)
            begin = at[:-1][lone] + offset[some]
            s1 = mix64(Hasher(data)(begin, begin + length))
            s2 = mix64(Hasher(data ^ 0x5A)(begin, begin + length))
            cols.append([np.ones(len(some), np.int64), h[lone], r[lone], offset[some], offset[some], s1.astype(np.int64), s2.astype(np.int64), times[mine[some]]])
        names = ["kind", "h", "r", "first", "last", "s1", "s2", "times"]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*cols)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, now = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "r", "n_sub", "c", "data", "sub"))):
                key = (row[0], row[5])
                if key != now and size >= TASK_BYTES:
                    yield from solve(rows)
                    rows, size = [], 0
                now = key
                rows.append(row)
                size += len(row[4])
        if rows:
            yield from solve(rows)

    dealt = classes.repartition("h", "sub").sortWithinPartitions("h", "sub", "r")
    return dealt.mapInArrow(run, "kind long, h long, r long, first long, last long, s1 long, s2 long, times long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _repeats(docs, length, gram, id_col, text_col, False)


def strip_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with the bytes that are left as ``kept`` and the removed spans as ``spans``."""
    return _repeats(docs, length, gram, id_col, text_col, True)


def _repeats(docs: DataFrame, length: int, gram: int, id_col: str, text_col: str, keep: bool) -> DataFrame:
    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                col = part.column("text").cast(pa.large_string())
                size = np.asarray(pc.binary_length(col), dtype=np.int64)
                data = np.frombuffer("".join(col.to_pylist()).encode(), dtype=np.uint8)
                bounds = spans(size)
                text, first, starts, h, r = regions(data, bounds, length, gram)
                offs = pa.array(spans(np.bincount(text, minlength=len(size))).astype(np.int32))
                got = pa.ListArray.from_arrays(offs, pa.StructArray.from_arrays([pa.array(x) for x in (h, r, first, starts)], ["h", "r", "first", "starts"]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "h1", "h2", "sha")), pa.array(size), got], names=["doc_id", "h1", "h2", "sha", "n_bytes", "found"])

    tune(docs.sparkSession)
    own = texts(docs, id_col, text_col)
    keyed = own.select("doc_id", "text", *row_key())
    shape = "doc_id long, h1 long, h2 long, sha string, n_bytes long, found array<struct<h:long,r:long,first:long,starts:long>>"
    signed = materialise(keyed.withColumn("sha", F.sha2("text", 256)).mapInArrow(anchor, shape), "anchored")
    key = ["h1", "h2"]
    # distinct texts with a number of their own; written, so the numbers stay
    nodes = signed.groupBy(*key).agg(F.count("*").alias("rows"), F.first("found").alias("found")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes, "nodes")
    spots = nodes.select("node", F.explode("found").alias("f")).select("node", "f.h", "f.r", F.col("f.first").cast("int").alias("first"), F.col("f.starts").cast("int").alias("starts"))
    often = spots.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    # what a corpus gives has no size bound: joins with it are sort-merge joins at every size, with the rows of hot keys dealt
    spot_count = nodes.agg(F.sum(F.size("found"))).first()[0] or 0
    occ = materialise(join_dealt(spots, often, ["h"], "n", spot_count).drop("n"), "shared")
    classes = materialise(occ.groupBy("h", "r").agg(F.count("*").alias("c"), F.min(F.struct("node", "first", "starts")).alias("rep")), "classes")
    occ_count, class_count = occ.count(), classes.count()
    per = classes.groupBy("h").agg(F.count("*").alias("k"), F.ceil(F.count("*") / GROUP_CLASSES).cast("int").alias("n_sub"))
    per = per.where("k > 1")
    several = join_dealt(classes, per, ["h"], "k", class_count).select("h", "r", "c", "n_sub", F.pmod(F.xxhash64("r"), F.col("n_sub")).cast("int").alias("sub"), "rep.*")
    wanted = several.groupBy("node").agg(F.collect_list(F.struct("h", "r", "c", "n_sub", "sub", "first", "starts")).alias("want"))  # regions of one text
    # texts with a region that occurs elsewhere are read once more, each once
    held = nodes.select("node", *key).join(occ.select("node").distinct(), "node", "left_semi")
    # copies are one before they are dealt
    some = materialise(keyed.groupBy(*key).agg(F.min("text").alias("text")).join(held.hint("merge"), key).select("node", "text"), "texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, want in zip(b.column("text").to_pylist(), b.column("want").to_pylist()):
                raw = text.encode()
                out += [(w["h"], w["r"], w["c"], w["n_sub"], w["sub"], raw[w["first"] : w["first"] + w["starts"] + length - 1]) for w in want]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["h", "r", "c", "n_sub", "sub", "data"])

    pieces = some.join(wanted.hint("merge"), "node").select("text", "want").mapInArrow(cut, "h long, r long, c long, n_sub int, sub int, data binary")
    marks = materialise(_compare(pieces, length), "marks")
    runs = marks.where("kind = 0").select("h", "r", "first", "last")
    lone = marks.where("kind = 1")
    again = lone.groupBy("s1", "s2").agg(F.sum("times").alias("t")).where("t > 1")
    across = lone.where("times = 1").join(again, ["s1", "s2"]).select("h", "r", "first", "last")
    alone = classes.groupBy("h").agg(F.count("*").alias("k"), F.first(F.struct("r", "c", "rep")).alias("x")).where("k = 1 and x.c > 1")
    alone = alone.select("h", "x.r", F.lit(0).cast("long").alias("first"), (F.col("x.rep.starts") - 1).cast("long").alias("last"))
    found = runs.unionByName(across).unionByName(alone).withColumnRenamed("first", "a").withColumnRenamed("last", "b")
    found = found.groupBy("h", "r").agg(F.collect_list(F.struct("a", "b")).alias("runs"))  # of one region
    found = found.join(classes.select("h", "r", "c").hint("merge"), ["h", "r"])
    covered = join_dealt(occ, found, ["h", "r"], "c", occ_count).withColumn("run", F.explode("runs")).select("node", "first", "run.a", "run.b").groupBy("node").agg(F.collect_list(F.struct((F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b") + length).alias("b"))).alias("cover"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, text, cover in zip(*(b.column(c).to_pylist() for c in ("node", "text", "cover"))):
                raw = text.encode()
                merged: list[list[int]] = []
                for x, y in sorted((c["a"], c["b"]) for c in cover):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], y)
                    else:
                        merged.append([x, y])
                left, at = [], 0
                for x, y in merged:
                    left.append(raw[at:x])
                    at = y
                rest = b"".join([*left, raw[at:]])
                out.append((node, len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), *([rest, merged] if keep else [])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary(), pa.list_(pa.list_(pa.int64()))] if keep else [])]
            names = ["node", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if keep else [])]
            cols = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=names)

    extra = ", kept binary, spans array<array<long>>" if keep else ""
    cleaned = some.join(covered.hint("merge"), "node").mapInArrow(strip, "node long, n_removed long, n_spans long, kept_sha256 string" + extra)
    empty = hashlib.sha256(b"").hexdigest()
    all_of_it = (F.col("rows") > 1) & (F.col("n_bytes") >= length)
    counted = materialise(nodes.select("node", *key, "rows").join(cleaned, "node", "left"), "counted")
    out = join_dealt(signed.select("doc_id", *key, "sha", "n_bytes"), counted, key, "rows", signed.count())
    result = out.select(
        "doc_id", "n_bytes",
        F.when(all_of_it, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(all_of_it, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(all_of_it, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([*key, F.when(all_of_it, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), F.when(all_of_it, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.col("spans")).alias("spans")] if keep else []),
    )
    if not keep:
        return result
    whole = result.join(keyed.groupBy(*key).agg(F.min("text").alias("text")), key)
    return whole.withColumn("kept", F.coalesce("kept", F.encode("text", "UTF-8"))).drop("text", *key)
