"""Benchmark decontamination by latent semantic retrieval.

1. Documents are cut into passages (overlapping windows of words) and counted over the benchmark's vocabulary:
   document frequencies by passage, over all passages.
2. Randomised SVD of the TF-IDF passages A, distributed: each task adds up A'(A W) over its passages for a fixed
   Gaussian W; the sum Z (vocabulary by rank) gives the leading right singular vectors (Nystroem step on A'A).
3. Every passage and every benchmark item is projected, and pairs with a cosine of at least ``least_cosine`` are
   candidates. So are all pairs whose words alone allow a match (``Lexical``), so that no leak hangs on rank or weights.
4. A candidate is a leak if the longest common subsequence of words of the item and of the text around the passage
   covers ``least_lcs`` of the item, and ``least_answer`` of the item's answer occurs there. The answer is the column
   ``answer`` if the benchmark has one, else the last quarter of the item's words.

Words are lower-cased and stripped of punctuation. Terms in more than ``stop`` of all passages carry no weight in the latent
space (they do in the word bound and the subsequence); the rarest words of each item weigh at least the median there. The benchmark is taken in blocks of
``ITEM_BLOCK`` items, each with its own vocabulary, so what tasks receive is bounded by the block.

Defined cases: null and empty texts and items match nothing; repeated rows give repeated results; items with equal
texts are found separately; an empty table or benchmark gives an empty result; a text shorter than a passage is one
passage; null item ids are kept as null; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, slices, spans, texts, tune
from .words import words

TRIM = ".,;:!?\"'()[]{}#$%&*"
WINDOW = 32
#: Items searched at a time.
ITEM_BLOCK = 2000
RANK = 96
#: Rare words of an item that must occur together before all its words are counted.
ANCHORS = 4
LEAKS = "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long, last_word long"


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one machine-word-parallel step per element of ``b``."""
    full = (1 << len(a)) - 1
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    v = full
    for y in b:
        m = masks.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Items:
    """A block of benchmark items over its own vocabulary."""

    ids: list[int | None]
    terms: list[list[int]]
    answers: list[set[int]]
    vocab: list[str]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        """Rows of id, text and (or None) answer."""
        index: dict[str, int] = {}
        ids, terms, answers = [], [], []
        for item_id, text, answer in rows:
            got = [index.setdefault(w, len(index)) for w in bare(text)]
            if got:
                ids.append(item_id)
                terms.append(got)
                answers.append({index.setdefault(w, len(index)) for w in bare(answer or "")})
        return cls(ids, terms, answers, list(index))


def bare(text: str) -> list[str]:
    return [w for w in (x.strip(TRIM) for x in text.lower().split()) if w]


class Lexical:
    """Candidates by words alone, which no match can escape.

    A match needs ``need`` of an item's words in the text around a passage, so of its ``m - need + j`` rarest words at
    least ``j`` occur there. Occurrences of these are counted in chunks as long as that text, which thus lies in two
    neighbouring chunks; where the two hold ``j``, all of the item's words are looked up, and their passages compared.
    """

    def __init__(self, terms: list[list[int]], df: np.ndarray, least_lcs: float):
        self.span = np.array([WINDOW + 2 * len(t) for t in terms], dtype=np.int64)
        self.need = np.zeros(len(terms), dtype=np.int64)
        self.least = np.zeros(len(terms), dtype=np.int64)
        anchors: list[tuple[int, int, int]] = []
        for i, t in enumerate(terms):
            m = len(t)
            need = next(k for k in range(m + 1) if not k < least_lcs * m)
            self.need[i] = need
            self.least[i] = j = max(1, min(need, ANCHORS))
            rare = sorted(t, key=lambda x: (df[x], x))[: m - need + j]
            anchors += [(x, i, c) for x, c in Counter(rare).items()]
        anchors.sort()
        self.item = np.array([a[1] for a in anchors], dtype=np.int64)
        self.times = np.array([a[2] for a in anchors], dtype=np.int64)
        self.start = np.searchsorted(np.array([a[0] for a in anchors], dtype=np.int64), np.arange(len(df) + 1))
        # every word of an item and how often, to count all of them
        self.words = [(np.array(list(c), dtype=np.int64), np.array(list(c.values()), dtype=np.int64)) for c in map(Counter, terms)]

    def pairs(self, cut: Cut) -> Iterator[tuple[int, int]]:
        """Passage and item."""
        at = np.flatnonzero(cut.term >= 0)
        term = cut.term[at]
        n = self.start[term + 1] - self.start[term]
        place = ranges(self.start[term], n)
        item, at, term, times = self.item[place], np.repeat(at, n), np.repeat(term, n), self.times[place]
        if not len(item):
            return
        most = len(cut.term) // WINDOW + 3
        key = item * most + at // self.span[item] + 1
        # each word once a chunk
        once = np.unique(key * (len(self.start) + 1) + term, return_index=True)[1]
        chunk, where = np.unique(key[once], return_inverse=True)
        held = np.bincount(where, weights=times[once]).astype(np.int64)
        both = np.unique(np.concatenate([chunk, chunk - 1]))
        count = np.zeros(len(both), dtype=np.int64)
        for shift in (0, 1):
            spot = np.minimum(np.searchsorted(chunk, both + shift), len(chunk) - 1)
            count += np.where(chunk[spot] == both + shift, held[spot], 0)
        both = both[count >= self.least[both // most]]
        doc = np.repeat(np.arange(len(cut.passages)), cut.passages)
        begins = cut.bounds[doc] + (np.arange(len(doc)) - cut.base[doc]) * (WINDOW // 2)
        for i, c in zip((both // most).tolist(), (both % most - 1).tolist()):
            span = int(self.span[i])
            here = np.sort(cut.term[max(0, c * span) : (c + 2) * span])
            words_, often = self.words[i]
            if not len(here) or often[here[np.minimum(np.searchsorted(here, words_), len(here) - 1)] == words_].sum() < self.need[i]:
                continue
            first = c * span + (span - WINDOW) // 2
            a, b = np.searchsorted(begins, (first, first + span)).tolist()
            for p in range(a, b):
                yield p, i


class Cut:
    """Passages of a slice of texts as occurrences of vocabulary terms."""

    def __init__(self, column: pa.Array, vocab: pa.Array):
        code, self.bounds, names = words(column)
        place = pc.fill_null(pc.index_in(pc.utf8_trim(names, characters=TRIM), value_set=vocab), -1)
        self.term = np.asarray(place, dtype=np.int64)[code] if len(code) else np.zeros(0, np.int64)
        count = np.diff(self.bounds)
        half = WINDOW // 2
        # a passage is two half windows; a text has one less than half windows, at least one
        halves = -(-count // half)
        self.passages = np.maximum(halves - 1, (count > 0).astype(np.int64))
        self.base = spans(self.passages)
        doc = np.repeat(np.arange(len(count)), count)
        self.spot = np.arange(len(self.term)) - self.bounds[doc]
        self.doc = doc

    def counts(self, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, term and how often, for terms with weight."""
        ok = self.term >= 0
        if weight is not None:
            ok &= weight[np.maximum(self.term, 0)] > 0
        term, doc = self.term[ok], self.doc[ok]
        half = self.spot[ok] // (WINDOW // 2)
        some, last = self.base[doc], self.passages[doc] - 1
        now, before = np.minimum(half, last), half - 1
        two = (before >= 0) & (before != now) & (before <= last)
        passage = np.concatenate([some + now, (some + before)[two]])
        n = len(weight) if weight is not None else int(self.term.max(initial=0)) + 1
        key, times = np.unique(passage * n + np.concatenate([term, term[two]]), return_counts=True)
        return key // n, key % n, times


def _unit(passage: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF values of unit rows, where rows begin, and the row of each value."""
    value = (times * weight[term]).astype(np.float32)
    head = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    row = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(passage))))
    return value / np.sqrt(np.add.reduceat(value * value, head))[row], head, row


def frequencies(docs: DataFrame, vocab: list[str]) -> tuple[np.ndarray, int]:
    """Passages with each term, and all passages."""
    names = pa.array(vocab, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(names) + 1, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch):
                cut = Cut(part.column("text"), names)
                if len(cut.term):
                    df += np.bincount(cut.counts(None)[1], minlength=len(df))
                n += int(cut.base[-1])
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], names=["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # the vocabulary of a block
    out = np.zeros(len(names) + 1, dtype=np.int64)
    for r in got:
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def latent(docs: DataFrame, vocab: list[str], weight: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Leading right singular vectors (vocabulary, <= rank) of the TF-IDF passages."""
    names = pa.array(vocab, pa.large_string())
    sketch = np.random.default_rng(seed).standard_normal((len(vocab), rank)).astype(np.float32)
    columns = [f"v{i}" for i in range(rank)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((len(names), rank))
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                passage, term, times = Cut(part.column("text"), names).counts(weight)
                if not len(term):
                    continue
                value, head, row = _unit(passage, term, times, weight)
                y = np.add.reduceat(value[:, None] * sketch[term], head)
                o = np.argsort(term, kind="stable")
                ts = term[o]
                first = np.flatnonzero(np.append(True, ts[1:] != ts[:-1]))
                z[ts[first]] += np.add.reduceat(value[o, None] * y[row[o]], first)
        some = np.flatnonzero(z.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(z[some, i]) for i in range(rank))], names=["term", *columns])

    sums = docs.select("text").mapInArrow(run, "term long, " + ", ".join(f"{c} double" for c in columns)).groupBy("term").agg(*(F.sum(c).alias(c) for c in columns))
    z = np.zeros((len(vocab), rank))
    for r in sums.collect():  # the vocabulary of a block
        z[r[0]] = r[1:]
    core = sketch.astype(float).T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > max(value.max(initial=0), 0) * 1e-9
    if not keep.any():
        return np.zeros((len(vocab), 1), dtype=np.float32)
    u, _, _ = np.linalg.svd(z @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    return u.astype(np.float32)


def _block(docs: DataFrame, items: Items, rank: int, stop: float, least_cosine: float, least_lcs: float, least_answer: float, answer_part: float, seed: int) -> DataFrame:
    df, n = frequencies(docs, items.vocab)
    idf = np.log((n + 1) / (df + 1.0))
    weight = np.maximum(0.0, idf + np.log(stop))
    floor = max(1.0, float(np.median(weight[weight > 0]))) if (weight > 0).any() else 1.0
    for terms in items.terms:  # the rarest words of an item count like others, however frequent the item makes them
        for t in sorted(set(terms), key=lambda x: (-idf[x], x))[:5]:
            weight[t] = max(weight[t], floor)
    answers = [given or set(terms[-max(1, round(answer_part * len(terms))) :]) for terms, given in zip(items.terms, items.answers)]
    axes = latent(docs, items.vocab, weight, rank, seed)
    probe = np.zeros((len(items.terms), axes.shape[1]), dtype=np.float32)
    for i, terms in enumerate(items.terms):
        for t, c in Counter(terms).items():
            probe[i] += np.float32(c * weight[t]) * axes[t]
    probe /= np.linalg.norm(probe, axis=1, keepdims=True) + 1e-12
    names, terms_of, ids = pa.array(items.vocab, pa.large_string()), items.terms, items.ids

    lexical = Lexical(items.terms, df, least_lcs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                cut = Cut(part.column("text"), names)
                if not (cut.term >= 0).any():
                    continue
                place, row = np.zeros((1, axes.shape[1]), np.float32), np.zeros(int(cut.base[-1]), np.int64)
                passage, term, times = cut.counts(weight)
                found = set(lexical.pairs(cut))
                if len(term):
                    value, head, _ = _unit(passage, term, times, weight)
                    place = np.add.reduceat(value[:, None] * axes[term], head)
                    place /= np.linalg.norm(place, axis=1, keepdims=True) + 1e-12
                    for s in range(0, len(place), 4096):
                        p, i = np.nonzero(place[s : s + 4096] @ probe.T >= least_cosine)
                        found.update(zip(passage[head[s + p]].tolist(), i.tolist()))
                    place = np.concatenate([np.zeros((1, axes.shape[1]), np.float32), place])
                    row[passage[head]] = np.arange(1, len(head) + 1)
                best: dict[tuple[int, int], tuple] = {}
                for at, i in sorted(found):
                    doc = int(np.searchsorted(cut.base, at, side="right")) - 1
                    want = terms_of[i]
                    begin = cut.bounds[doc] + (at - cut.base[doc]) * (WINDOW // 2)
                    first = max(int(cut.bounds[doc]), int(begin) - len(want))
                    last = min(int(cut.bounds[doc + 1]), int(begin) + WINDOW + len(want))
                    around = cut.term[first:last].tolist()
                    here = set(around)
                    held = len(answers[i] & here) / len(answers[i])
                    # words of the item that occur at all bound the subsequence
                    if held < least_answer or sum(t in here for t in want) < least_lcs * len(want):
                        continue
                    share = lcs(want, around) / len(want)
                    if share >= least_lcs:
                        key = (doc, i)
                        got = (share, float(place[row[at]] @ probe[i]), held, first - int(cut.bounds[doc]), last - int(cut.bounds[doc]))
                        if key not in best or got > best[key]:
                            best[key] = got
                if best:
                    out = sorted(best.items())
                    doc_ids = part.column("doc_id").take(pa.array([k[0] for k, _ in out]))
                    cols = [[v[j] for _, v in out] for j in (1, 0, 2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array([ids[k[1]] for k, _ in out], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[:3]), *(pa.array(c, pa.int64()) for c in cols[3:])], names=[x.split()[0] for x in LEAKS.split(", ")])

    return docs.mapInArrow(run, LEAKS)


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, stop: float = 0.01, least_cosine: float = 0.45, least_lcs: float = 0.6, least_answer: float = 0.5, answer_part: float = 0.25, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it leaks: cosine, share of the item in the common subsequence,
    share of its answer, and the words of the document compared."""
    spark = docs.sparkSession
    tune(spark)
    own = texts(docs, id_col, text_col)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    listed = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"), answer.alias("answer"))
    out = spark.createDataFrame([], LEAKS)
    n = listed.count()
    blocks = -(-n // ITEM_BLOCK)
    for b in range(blocks):
        rows = [tuple(r) for r in listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]  # about ITEM_BLOCK items
        items = Items.of(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if items.ids:
            out = out.unionByName(_block(own, items, rank, stop, least_cosine, least_lcs, least_answer, answer_part, seed))
    return out
