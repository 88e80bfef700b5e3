"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic gradient boosting: round after round, each feature in turn gets one shallow tree on that feature alone,
fitted to the residuals at a small rate; the trees of a feature sum up to one lookup table over its bins. Then the
pairs of features that explain most of what is left get tables over coarser bins, boosted the same way. A score
is the intercept plus one table entry per feature and pair: vectorised additions.

Features come from the text only. Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0; at most
``fit_rows`` of them are used (those with the smallest hash of doc_id), which bounds what the driver gathers.

Defined cases: null and empty texts have all-zero features and are scored like any other; a document labelled more
than once counts with its mean label; null labels are left out; without any labelled row every score is 0.5;
repeated rows give repeated results; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, spans, texts, tune

FEATURES = ("words", "word_length", "distinct", "repeated", "top_word", "upper", "digits", "bars", "shouts", "symbols", "stops", "lines", "beyond_ascii", "repeated_pairs", "long_words")
#: Labelled rows that the fit takes at most.
FIT_ROWS = 40_000
#: From this score on a document is predicted to have label 1.
CUT = 0.3


def _classes() -> np.ndarray:
    kind = np.zeros(256, dtype=np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 9
    for chars, k in (("|", 4), ("!", 5), ("#$%&*@^~=<>{}[]\\/_+`", 6), (".,;:?", 7), ("\n", 8)):
        for c in chars:
            kind[ord(c)] = k
    return kind


KIND = _classes()


def features(column: pa.Array) -> np.ndarray:
    """Features (n, len(FEATURES)) of texts."""
    n = len(column)
    size = np.asarray(pc.binary_length(column), dtype=np.int64)
    joined = "\n".join(column.to_pylist()).encode() + b"\n"
    kind = KIND[np.frombuffer(joined, dtype=np.uint8)]
    at = spans(size + 1)
    each = {k: np.add.reduceat(kind == k, at[:-1], dtype=np.int64).astype(float) for k in range(1, 10)}
    each[8] -= 1
    lists = pc.utf8_split_whitespace(pc.utf8_lower(column.cast(pa.large_string())))
    coded = lists.flatten().dictionary_encode()
    width = np.asarray(pc.utf8_length(coded.dictionary), dtype=np.int64)
    code = np.asarray(coded.indices, dtype=np.int64)
    bound = np.asarray(lists.offsets, dtype=np.int64)
    bound = bound - bound[0]
    lens = np.diff(bound)
    doc = np.repeat(np.arange(n), lens)
    solid = width[code] > 0  # a split at the ends of a text leaves empty words
    code, doc = code[solid], doc[solid]
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    total = max(len(coded.dictionary), 1)
    pair, times = np.unique(doc * total + code, return_counts=True)
    home = pair // total
    distinct = np.bincount(home, minlength=n) / some
    top = np.zeros(n)
    np.maximum.at(top, home, times / some[home])
    same = (doc[1:] == doc[:-1]) & (code[1:] == code[:-1])
    repeated = np.bincount(doc[1:][same], minlength=n) / some
    step = doc[1:] == doc[:-1]
    two = (doc[1:] * total + code[1:])[step] * 1_000_003 + code[:-1][step]
    seen, how_many = np.unique(two, return_counts=True)
    first = np.unique(two, return_index=True)[1]
    pair_home = doc[1:][step][first]
    pairs = 1 - np.bincount(pair_home, minlength=n) / np.maximum(np.bincount(pair_home, how_many, minlength=n), 1) if len(seen) else np.zeros(n)
    pairs = np.where(words > 1, pairs, 0.0)
    letters = np.maximum(each[1] + each[2], 1)
    out = [
        np.log1p(words), np.bincount(doc, width[code], minlength=n) / some, distinct, repeated, top, each[2] / letters, each[3] / np.maximum(size, 1),
        each[4] / some, each[5] / some, each[6] / some, each[7] / some, each[8] / some, each[9] / np.maximum(size, 1), pairs, np.bincount(doc[width[code] > 20], minlength=n) / some,
    ]
    return np.column_stack(out)


@dataclass
class Model:
    """Cuts by feature, a table by feature, and for each pair its cuts and table."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cut, x[:, f], side="left")]
        for f, g, cf, cg, table in self.pairs:
            out += table[np.searchsorted(cf, x[:, f], side="left"), np.searchsorted(cg, x[:, g], side="left")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    seen = np.unique(v)
    if len(seen) <= bins:
        return (seen[1:] + seen[:-1]) / 2
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, floor: float = 1.0) -> np.ndarray:
    """Leaf values by bin of a shallow tree over ordered bins with gradient sums g and weights h."""
    edges = [(0, len(g))]
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    while len(edges) < leaves:
        best = (1e-9, None, 0)
        for e in edges:
            a, b = e
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, hl, gr, hr = cg[m] - cg[a], ch[m] - ch[a], cg[b] - cg[m], ch[b] - ch[m]
            gain = gl**2 / (hl + floor) + gr**2 / (hr + floor) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + floor)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], e, int(m[i]))
        if best[1] is None:
            break
        edges.remove(best[1])
        edges += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in edges:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + floor)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.1, bins: int = 48, pair_bins: int = 8, n_pairs: int = 8, leaves: int = 4) -> Model:
    """Cyclic boosting of one-feature trees, then of pair tables on what is left."""
    if not len(y):
        return Model(0.0, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(float(np.log(p / (1 - p))))
    model.cuts = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
    code = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    logit = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f, c in enumerate(code):
            q = 1 / (1 + np.exp(-logit))
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(c, y - q, minlength=size), np.bincount(c, q * (1 - q), minlength=size), leaves)
            model.tables[f] += step
            logit += step[c]
    coarse = [_cuts(x[:, f], pair_bins) for f in range(x.shape[1])]
    small = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(coarse)]
    q = 1 / (1 + np.exp(-logit))
    gains = []
    for f in range(x.shape[1]):
        for g in range(f + 1, x.shape[1]):
            cell = small[f] * (len(coarse[g]) + 1) + small[g]
            s, w = np.bincount(cell, y - q), np.bincount(cell, q * (1 - q))
            gains.append((float((s**2 / (w + 1)).sum()), f, g))
    for _, f, g in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs.append((f, g, coarse[f], coarse[g], np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1))))
    for _ in range(pair_rounds):
        for f, g, _, _, t in model.pairs:
            cell = small[f] * t.shape[1] + small[g]
            q = 1 / (1 + np.exp(-logit))
            s, w = (np.bincount(cell, v, minlength=t.size).reshape(t.shape) for v in (y - q, q * (1 - q)))
            # a tree of two levels: the best rows of f, and in each the best columns of g
            rows = _tree(s.sum(1), w.sum(1), 2)
            step = np.zeros(t.shape)
            for v in np.unique(rows):
                part = rows == v
                step[part] = _tree(s[part].sum(0), w[part].sum(0), 2)
            t += rate * step
            logit += rate * step.ravel()[cell]
    return model


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a hash of the text and the features of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h1"), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", "h1", *FEATURES])

    tune(docs.sparkSession)
    return texts(docs, id_col, text_col).withColumn("h1", F.xxhash64("text")).mapInArrow(run, "doc_id long, h1 long, " + ", ".join(f"{f} double" for f in FEATURES))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def _least(x: DataFrame, marks: DataFrame, n: int):
    return x.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(n).toPandas()


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, text_hash (xxhash64 of the text)."""
    x = materialise(measured(docs, id_col, text_col), "features")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null and doc_id is not null").where(~held_out())
    marks = materialise(marks.groupBy("doc_id").agg(F.avg("y").alias("y")), "marks")
    # the labelled rows with the least hashes: a bound on the hash first, so that few rows travel beside those taken
    part = (1.2 * fit_rows + 1000) / max(marks.count(), 1)
    near = marks.where(F.xxhash64("doc_id") < F.lit(int(-(2**63) + part * 2**64))) if part < 1 else marks
    taken = _least(x, near, fit_rows)
    if part < 1 and len(taken) < fit_rows:  # labels without a document
        taken = _least(x, marks, fit_rows)
    model = fit(taken[list(FEATURES)].to_numpy(float), taken["y"].to_numpy(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.score(np.column_stack([np.asarray(b.column(f)) for f in FEATURES]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h1"), pa.array(got), pa.array((got >= cut).astype(np.int32))], names=["doc_id", "h1", "score", "predicted"])

    scored = x.mapInArrow(run, "doc_id long, h1 long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", F.col("h1").alias("text_hash"))
