"""Best-fit packing of tokenized documents into sequences, after a dominance reduction.

Documents become pieces of at most ``capacity`` tokens. What must be packed is only the histogram of piece
lengths, which has at most ``capacity`` rows however large the corpus is, so it is solved on the driver:

1. Dominance reduction (Martello and Toth): from the longest length down, a set of one to three pieces that
   provably is at least as good as any other set with its longest piece is fixed for good, as often as the
   counts allow, and the instance shrinks.
2. The remainder is packed best-fit decreasing, with all pieces of one length and all sequences of one
   residual handled at a time.

The solution is a list of runs: the pieces of length L with ranks a .. b go to sequences s, s + 1, ... at a
fixed offset. Ranks are dealt by (length, hash) buckets,
as many as the length's pieces need, so a length that a third of all pieces have is spread.

Defined cases: null and empty texts are documents with the closing id alone; repeated rows are packed as often
as they occur; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise, ranges, slices, spans, texts, tune
from .wordtok import Encoder, default_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows in a bucket of one length, on average, within which ranks are dealt by a sort.
BUCKET_ROWS = 1_000


def pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize each document once, close it with ``end_id`` and cut it into pieces of ``capacity`` ids."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path)
        for batch in batches:
            for part in slices(batch, limit=8 << 20):
                flat, at, _, _ = enc.encode(part.column("text"), spots=False)
                lens = np.diff(at) + 1
                out = np.empty(int(lens.sum()), dtype="<u4")
                to = spans(lens)
                out[to[1:] - 1] = end_id
                out[ranges(to[:-1], lens - 1)] = flat
                n = -(-lens // capacity)
                which = np.repeat(np.arange(len(lens)), n)
                piece = ranges(np.zeros(len(n), np.int64), n)
                start = piece * capacity
                length = np.minimum(lens[which] - start, capacity)
                begin = to[:-1][which] + start
                raw = memoryview(out).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(begin.tolist(), length.tolist())]
                ids = part.column("doc_id").take(pa.array(which))
                yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    tune(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, PIECES)


class Solution:
    """Runs of ranks by length: (length, first rank, pieces, pieces per sequence, first sequence, offset)."""

    def __init__(self, counts: dict[int, int]):
        self.next = dict.fromkeys(counts, 0)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def add(self, items: list[tuple[int, int]], times: int) -> None:
        """``times`` sequences that hold, for each (length, q) of ``items``, q pieces of that length."""
        offset = 0
        for length, q in items:
            self.runs.append((length, self.next[length], q * times, q, self.sequences, offset))
            self.next[length] += q * times
            offset += q * length
        self.sequences += times


def reduce_dominated(counts: dict[int, int], capacity: int, out: Solution) -> None:
    """Fix what provably dominates, longest pieces first; ``counts`` keeps the shrunken instance.

    With longest piece L and r = capacity - L, let k be the largest other piece that fits. {L} is fixed if none
    fits; {L, k} if k fills r, if no two others fit together, or if no two that fit exceed k; {L, a, b} if no
    three others fit, a + b is the best pair, k <= a, and every pair that fits can take the places of a and b.
    """
    have = sorted(x for x, c in counts.items() if c > 0)

    def take(*parts: int, times: int) -> None:
        out.add([(x, 1) for x in parts], times)
        for x in parts:
            counts[x] -= times
            if not counts[x]:
                have.remove(x)

    def most(*parts: int) -> int:
        return min(counts[x] // parts.count(x) for x in set(parts))

    for length in sorted(have, reverse=True):
        while counts[length] > 0:
            room = capacity - length
            counts[length] -= 1  # the piece itself is not among the others
            gone = not counts[length]
            if gone:
                have.remove(length)
            small: list[int] = []
            for x in have:
                small += [x] * min(3, counts[x])
                if len(small) >= 3:
                    break
            at = bisect_left(have, room + 1)
            k = have[at - 1] if at else 0
            pair = (0, 0)
            fits = ()
            if not k:
                fits = (length,)
            elif k == room or len(small) < 2 or small[0] + small[1] > room:
                fits = (length, k)
            elif len(small) < 3 or sum(small[:3]) > room:
                for a in have[:at]:  # a the larger of the pair
                    b = room - a
                    i = bisect_left(have, min(a, b) + 1)
                    if i and have[i - 1] == a and counts[a] < 2:
                        i -= 1
                    if i and a + have[i - 1] > sum(pair):
                        pair = (a, have[i - 1])
                if sum(pair) <= k:
                    fits = (length, k)
                elif k <= pair[0]:
                    good = True
                    for a in have[:at]:
                        i = bisect_left(have, min(a, room - a) + 1)
                        if i and have[i - 1] == a and counts[a] < 2:
                            i -= 1
                        if i and not (a <= pair[0] and (have[i - 1] <= pair[1] or a + have[i - 1] <= pair[0])):
                            good = False
                            break
                    if good:
                        fits = (length, *pair)
            counts[length] += 1
            if gone:
                insort(have, length)
            if not fits:
                break
            # one set more leaves a smaller instance, where the same proof holds while all its pieces remain; a proof
            # that counts copies of the set's own pieces looks at three at most, so it holds while four remain
            free = len(set(fits)) == len(fits) or k == room
            take(*fits, times=most(*fits) if free else max(1, min((counts[x] - 4) // fits.count(x) for x in fits)))


def best_fit(counts: dict[int, int], capacity: int, out: Solution) -> None:
    """Best-fit decreasing over the histogram: sequences of one content form a class with a count."""
    open_: dict[int, list[tuple[tuple, int]]] = {}  # residual -> [(chain of (previous, length, q), sequences)]
    rooms: list[int] = []

    def put(room: int, chain: tuple, times: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((chain, times))

    for length in sorted((x for x, c in counts.items() if c > 0), reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                chain, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, chain, times = capacity, (), left
            q = room // length
            full = min(times, left // q)
            rest = min(left - full * q, q - 1) if full < times else 0
            put(room - q * length, (chain, length, q), full)
            put(room - rest * length, (chain, length, rest), 1 if rest else 0)
            if room < capacity:
                put(room, chain, times - full - (1 if rest else 0))
            left -= full * q + rest
        counts[length] = 0
    for room in rooms:
        for chain, times in open_[room]:
            items = []
            while chain:
                chain, length, q = chain
                items.append((length, q))
            out.add(items[::-1], times)


def solve(counts: dict[int, int], capacity: int) -> Solution:
    """Runs that pack pieces with these counts by length; ``counts`` is not changed."""
    left = {int(x): int(c) for x, c in counts.items() if c > 0}
    out = Solution(left)
    reduce_dominated(left, capacity, out)
    best_fit(left, capacity, out)
    return out


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialise(pieces(docs, capacity, end_id, tokenizer, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    # buckets by length: at most ``capacity`` rows
    sizes = cut.sparkSession.createDataFrame([(x, -(-n // BUCKET_ROWS)) for x, n in counts.items()], "length long, buckets long")
    plan = solve(counts, capacity)
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 6)
    # a key that rises with (length, rank); runs are ordered by it
    top = np.int64(1) << 44
    key = runs[:, 0] * top + runs[:, 1]

    tied = cut.join(F.broadcast(sizes), "length").withColumn("b", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("buckets"))).drop("buckets")
    before = (
        tied.groupBy("length", "b").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("b").rowsBetween(W.unboundedPreceding, -1)))
        .select("length", "b", F.coalesce("before", F.lit(0)).alias("before"))
    )
    order = W.partitionBy("length", "b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = tied.withColumn("rn", F.row_number().over(order)).join(before, ["length", "b"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rn") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (np.asarray(b.column(x), dtype=np.int64) for x in ("length", "rank"))
            r = runs[np.searchsorted(key, length * top + rank, side="right") - 1]
            within = rank - r[:, 1]
            seq = r[:, 4] + within // r[:, 3]
            off = r[:, 5] + within % r[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
