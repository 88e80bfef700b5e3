"""Edit distances, alignment and agreement of texts and layouts; vectorised where built-ins end."""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_rows(a, b) -> list[int]:
    """Last row of the edit-distance table: distances of all of ``a`` from every prefix of ``b``."""
    codes: dict = {}
    x = np.array([codes.setdefault(v, len(codes)) for v in a], dtype=np.int64)
    y = np.array([codes.setdefault(v, len(codes)) for v in b], dtype=np.int64)
    place = np.arange(len(y) + 1)
    row = place.copy()
    for i, v in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != v))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - place) + place
    return row.tolist()


def edits(a, b) -> int:
    return edit_rows(a, b)[-1]


def whole_edits(a: str, b: str) -> int:
    """``edits`` of texts of any length.

    No fewer edits do than the letters that one bag has over the other. Where the words, each put in the place of the word beside
    it, need no more, that is the distance; all other texts are compared as a whole.
    """
    head = len(os.path.commonprefix([a, b]))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    x, y = a.split(" "), b.split(" ")
    if 1 < len(x) == len(y):
        least, sum_ = _least(a, b), 0
        for p, q in zip(x, y):
            if p != q:
                sum_ += _word_edits(p, q) if len(p) + len(q) < WORD else _bit_edits(p, q)
                if sum_ > least:
                    break
        if sum_ == least:
            return least
    return _bit_edits(a, b)


#: Letters of two words up to which their edits are kept.
WORD = 80


def _least(a: str, b: str) -> int:
    """Letters that one bag has over the other, whichever are more."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    n = int(max(x.max(), y.max())) + 1
    over = np.bincount(x, minlength=n) - np.bincount(y, minlength=n)
    return int(max(over[over > 0].sum(), -over[over < 0].sum()))


def _bit_edits(a: str, b: str) -> int:
    """``edits``: a column of the table at a time as bits of one number (Myers)."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, bytearray] = {}
    for i, c in enumerate(a):
        if c not in masks:
            masks[c] = bytearray(-(-len(a) // 8))
        masks[c][i >> 3] |= 1 << (i & 7)
    eq = {c: int.from_bytes(m, "little") for c, m in masks.items()}
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        e = eq.get(c, 0)
        x = (((e & up) + up) ^ up) | e | down
        more, less = down | (full & ~(x | up)), up & x
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, less << 1 & full
        e |= down
        up, down = less | (full & ~(e | more)), more & e
    return score


_word_edits = lru_cache(100_000)(_bit_edits)


def infix(p, t) -> int:
    """The fewest edits that turn ``p`` into some run of ``t``."""
    codes: dict = {}
    x = np.array([codes.setdefault(v, len(codes)) for v in p], dtype=np.int64)
    y = np.array([codes.setdefault(v, len(codes)) for v in t], dtype=np.int64)
    place = np.arange(len(y) + 1)
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for i, v in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != v))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - place) + place
    return int(row.min())


def align(a, b) -> list[tuple[str, int, int]]:
    """Operations (equal, substitute, delete, insert) with places in both; on ties the diagonal is taken first."""
    n, m = len(a), len(b)
    d = np.zeros((n + 1, m + 1), dtype=np.int64)
    d[:, 0], d[0] = np.arange(n + 1), np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("equal" if a[i] == b[j] else "substitute", i, j))
        elif i and d[i, j] == d[i - 1, j] + 1:
            i -= 1
            out.append(("delete", i, j))
        else:
            j -= 1
            out.append(("insert", i, j))
    return out[::-1]


def split_edits(a, b) -> tuple[int, int, int]:
    """Substitutions, insertions and deletions of a least alignment."""
    c = Counter(k for k, _, _ in align(a, b))
    return c["substitute"], c["insert"], c["delete"]


def error_rate(e: Column, size: Column) -> Column:
    """Edits over length; nothing of nothing is 0, something of nothing 1."""
    return F.when(size > 0, e / size).when(e > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def whole_levenshtein(a: Column, b: Column) -> Column:
    """Edits between whole texts; null where one is null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else whole_edits(p, q) for p, q in zip(x, y)], dtype="Int64")

    return F.pandas_udf(run, "long")(a, b)


def pair_metrics(a: Column, b: Column, edits: Column | None = None) -> dict[str, Column]:
    """Character error rates both ways and over the mean length; ``edits`` if they are known."""
    e, la, lb = F.levenshtein(a, b) if edits is None else edits, F.length(a), F.length(b)
    return {"cer_a": error_rate(e, lb), "cer_b": error_rate(e, la), "cer_sym": error_rate(e, (la + lb) / 2)}


def dice(words_a: Column, words_b: Column) -> Column:
    """Dice overlap of two bags of words (arrays); two empty bags agree."""
    common = F.aggregate(F.array_distinct(words_a), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(words_a, lambda x: x == w)), F.size(F.filter(words_b, lambda x: x == w))))
    total = F.size(words_a) + F.size(words_b)
    return F.when(total > 0, 2 * common / total).otherwise(F.lit(1.0))


def whole_dice(words_a: Column, words_b: Column) -> Column:
    """``dice`` of bags of any size."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([2 * (Counter(p) & Counter(q)).total() / (len(p) + len(q)) if len(p) + len(q) else 1.0 for p, q in zip(x, y)], dtype="float64")

    return F.when(words_a.isNotNull() & words_b.isNotNull(), F.pandas_udf(run, "double")(F.coalesce(words_a, F.array().cast("array<string>")), F.coalesce(words_b, F.array().cast("array<string>"))))


def hat3(ab: Column, ac: Column, bc: Column) -> dict[str, Column]:
    """Errors of three readers from their pairwise differences, not below 0."""
    zero = F.lit(0.0)
    return {"a": F.greatest((ab + ac - bc) / 2, zero), "b": F.greatest((ab + bc - ac) / 2, zero), "c": F.greatest((ac + bc - ab) / 2, zero)}


def hat(n: int, pairs: list[tuple[int, int, float]]) -> list[float] | None:
    """Errors of n readers by least squares; None for fewer than three readers or n pairs."""
    if n < 3 or len(pairs) < n:
        return None
    m = np.zeros((len(pairs), n))
    for r, (i, j, _) in enumerate(pairs):
        m[r, i] = m[r, j] = 1
    if np.linalg.matrix_rank(m) < n:
        return None
    got, *_ = np.linalg.lstsq(m, np.array([d for _, _, d in pairs]), rcond=None)
    return np.maximum(got, 0).tolist()


def iou(a, b) -> float:
    """Intersection over union of boxes (x, y, w, h)."""
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inside = max(w, 0) * max(h, 0)
    union = a[2] * a[3] + b[2] * b[3] - inside
    return inside / union if union > 0 else 0.0


def match_boxes(gold: list, found: list[tuple], least: float = 0.5) -> list[tuple[int, int]]:
    """One-to-one matches: found boxes (score, box) by score take the free gold box with the largest overlap."""
    free, out = set(range(len(gold))), []
    for i in sorted(range(len(found)), key=lambda k: -found[k][0]):
        best = max(sorted(free), key=lambda g: iou(gold[g], found[i][1]), default=None)
        if best is not None and iou(gold[best], found[i][1]) >= least:
            free.remove(best)
            out.append((best, i))
    return out


def order_agreement(pairs: list[tuple[int, int]]) -> tuple[float, float]:
    """Kendall's tau of matched reading orders, and the share of neighbours that stay in order."""
    seq = [b for _, b in sorted(pairs)]
    n = len(seq)
    if n < 2:
        return 1.0, 1.0
    s = np.array(seq)
    inversions = int(sum((s[:i] > s[i]).sum() for i in range(1, n)))
    return 1 - 2 * inversions / (n * (n - 1) / 2), float((s[1:] > s[:-1]).mean())


def read_twice(size: int, tile: int = 1280, overlap: int = 256) -> list[tuple[int, int]]:
    """Where, along one axis, the inner parts of neighbouring tiles both cover a page: the last tile ends with the page."""
    if size <= tile:
        return []
    starts = [*range(0, size - tile, tile - overlap), size - tile]
    inner = [(a + overlap // 2, a + tile - overlap // 2) for a in starts]
    return [(right[0], left[1]) for left, right in zip(inner, inner[1:]) if left[1] > right[0]]


def without_repeats(words: list[tuple[float, float, float, float]], width: int, height: int, share: float = 0.5) -> list[bool]:
    """For each word's box (x0, y0, x1, y1) whether it stays: in a part read twice, a word that a kept word of such a part covers
    by ``share`` of the smaller of both does not."""
    zones = [(0, *z) for z in read_twice(width)] + [(1, *z) for z in read_twice(height)]
    seen: list[tuple[float, float, float, float]] = []
    out = []
    for w in words:
        middle = ((w[0] + w[2]) / 2, (w[1] + w[3]) / 2)
        stays = True
        if any(a <= middle[axis] < b for axis, a, b in zones):
            for k in seen:
                across, down = (min(w[i + 2], k[i + 2]) - max(w[i], k[i]) for i in (0, 1))
                least = min((x[2] - x[0]) * (x[3] - x[1]) for x in (w, k)) or 1
                if across > 0 and down > 0 and across * down / least >= share:
                    stays = False
                    break
            if stays:
                seen.append(w)
        out.append(stays)
    return out


def xy_cut(boxes: list[tuple[float, float, float, float]], right_to_left: bool = False) -> list[int]:
    """Reading order of boxes: cut at the widest gap, across first where gaps are equal, and go on in the parts."""

    def gap(ids: list[int], axis: int) -> tuple[float, float]:
        edges = sorted((boxes[i][axis], boxes[i][axis] + boxes[i][axis + 2]) for i in ids)
        best, reach = (0.0, 0.0), edges[0][1]
        for a, b in edges[1:]:
            if a - reach > best[0]:
                best = (a - reach, (a + reach) / 2)
            reach = max(reach, b)
        return best

    def walk(ids: list[int]) -> list[int]:
        if len(ids) < 2:
            return ids
        across, down = gap(ids, 0), gap(ids, 1)
        if max(across[0], down[0]) <= 0:
            return sorted(ids, key=lambda i: (boxes[i][1], -boxes[i][0] if right_to_left else boxes[i][0]))
        axis, cut = (0, across[1]) if across[0] >= down[0] else (1, down[1])
        one, two = [i for i in ids if boxes[i][axis] < cut], [i for i in ids if boxes[i][axis] >= cut]
        if axis == 0 and right_to_left:
            one, two = two, one
        return walk(one) + walk(two)

    return walk(list(range(len(boxes))))


def bm25(tf: Column, df: Column, n: Column, size: Column, mean_size: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """A term's score in a text."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean_size))
