"""What several readings of one page agree on: words of a consensus, confusions, and the parts that two readings share."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations, count, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalise

#: Columns of an alignment's table that are made at a time: as many as have so many cells (of two bits), this many at least.
CELLS, ROWS = 64_000_000, 256
#: Differing words that a task counts before it hands over what they are.
HELD = 200_000
#: Words in a chunk, words beside its place, an anchor's least letters and most places, anchors that must agree and
#: within how many words, errors above which a chunk is halved or has no place, words of the smallest half.
CHUNK, BESIDE, LETTERS, PLACES, ANCHORS, BAND, HALVE, LOST, LEAST = 40, 12, 4, 2, 2, 6, 0.2, 0.5, 10

#: Bits of a word, pairs side by side at most, pairs (and two more a word) below which one at a time is faster, entries of a table of
#: letters, and letters of the texts whose pieces are compared together.
BITS, SIDE, FEW, TABLE, TOGETHER = 63, 2048, 16, 2_000_000, 2_000_000


def _straight(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether word beside word is a least alignment: as many are equal in place as both have in common as bags.

    No alignment has fewer edits than the words that the other bag lacks, and if this one has no more, none of its beginnings
    has: on the way back every step is on the diagonal, which is taken first.
    """
    if len(x) != len(y) or not len(x):
        return False
    n = int(max(x.max(), y.max())) + 1
    return int((x == y).sum()) == int(np.minimum(np.bincount(x, minlength=n), np.bincount(y, minlength=n)).sum())


def _path(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps of ``distance.align`` for codes: places in both, -1 where one has none.

    A column of the table at a time as bits of one number (Myers). A column keeps where the diagonal costs nothing and where the
    row above is one less, which is all that the way back asks. Every so many columns the state is kept, and the columns
    between are made on the way back, so a long text's whole table is never held.
    """
    if _straight(x, y):
        return np.arange(len(x)), np.arange(len(y))
    x, y = x.tolist(), y.tolist()
    i, j, back = len(x), len(y), []
    while i and j and x[i - 1] == y[j - 1]:
        i, j = i - 1, j - 1
        back.append((i, j))
    if i and j:
        masks: dict[int, bytearray] = {}
        size = -(-i // 8)
        for k in range(i):
            if x[k] not in masks:
                masks[x[k]] = bytearray(size)
            masks[x[k]][k >> 3] |= 1 << (k & 7)
        eq = {c: int.from_bytes(m, "little") for c, m in masks.items()}
        full = (1 << i) - 1
        size = max(ROWS, CELLS // (i + 1))

        def columns(up: int, down: int, begin: int, end: int, keep: list | None):
            for c in y[begin:end]:
                e = eq.get(c, 0)
                free = (((e & up) + up) ^ up) | e | down
                more, less = (down | full & ~(free | up)) << 1 | 1, (up & free) << 1
                up, down = (less | ~(free | more)) & full, more & free & full
                if keep is not None:
                    keep.append((free, up))
            return up, down

        marks, last = [(full, 0)], (j - 1) // size
        for k in range(last):
            marks.append(columns(*marks[-1], k * size, (k + 1) * size, None))
        for k in range(last, -1, -1):
            begin, kept = k * size, []
            columns(*marks[k], begin, j, kept)
            while i and j > begin:
                free, up = kept[j - 1 - begin]
                if x[i - 1] == y[j - 1] or not free >> (i - 1) & 1:
                    i, j = i - 1, j - 1
                    back.append((i, j))
                elif up >> (i - 1) & 1:
                    i -= 1
                    back.append((i, -1))
                else:
                    j -= 1
                    back.append((-1, j))
            if not i:
                break
    back += [(k, -1) for k in range(i - 1, -1, -1)] + [(-1, k) for k in range(j - 1, -1, -1)]
    out = np.array(back[::-1], dtype=np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _codes(texts) -> list[np.ndarray]:
    """Equal items of several sequences as equal numbers."""
    codes = defaultdict(count().__next__)
    return [np.fromiter(map(codes.__getitem__, t), np.int64, len(t)) for t in texts]


def steps(a, b) -> list[tuple[str, int, int]]:
    """What ``distance.align`` gives, for texts of any length."""
    out, i, j = [], 0, 0
    for p, q in zip(*(k.tolist() for k in _path(*_codes((a, b))))):
        out.append(("insert" if p < 0 else "delete" if q < 0 else "equal" if a[p] == b[q] else "substitute", i, j))
        i, j = i + (p >= 0), j + (q >= 0)
    return out


def printed_words(text: str | None) -> list[str]:
    """Words as printed, without signs around them."""
    return re.findall(r"[^\W_](?:\S*[^\W_])?", normalise(text or ""))


def _agreed(readings: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By reading and word of the consensus its place or -1, the words' order being of no meaning, and by difference the
    reading, the reading that has the word, its place there and the own place or -1.

    Places of all readings are numbered one after another.
    """
    low = _codes([list(map(str.lower, r)) for r in readings])
    first = np.cumsum([0, *map(len, low)])
    n, of = int(first[-1]), np.repeat(np.arange(len(low)), [len(t) for t in low])
    links, swaps, gaps = [], [np.empty((0, 3), np.int64)], [np.empty((0, 3), np.int64)]
    for r, s in combinations(range(len(low)), 2):
        p, q = _path(low[r], low[s])
        both = (p >= 0) & (q >= 0)
        u, v = np.where(p < 0, -1, p + first[r]), np.where(q < 0, -1, q + first[s])
        same = both.copy()
        same[both] = low[r][p[both]] == low[s][q[both]]
        links.append((u[same], v[same]))
        u, v = u[~same], v[~same]
        whole = (u >= 0) & (v >= 0)
        x, y = u[whole], v[whole]
        swaps.append(np.stack([np.full(len(x), r), y, x, np.full(len(x), s), x, y], 1).reshape(-1, 3))
        x, y = u[~whole], v[~whole]
        gaps.append(np.stack([np.where(y < 0, s, r), np.maximum(x, y), np.full(len(x), -1)], 1))
    word = np.arange(n)  # of each place, as its least place
    before = None
    while before is None or (before != word).any():
        before = word.copy()
        for u, v in links:
            word[u] = word[v] = np.minimum(word[u], word[v])
        word = word[word]
    place, times = np.unique(word * len(low) + of, return_counts=True)
    if (times > 1).any():
        _take_turns(word, of, links, np.unique(place[times > 1] // len(low)))
    size = np.bincount(word, minlength=n)
    has = np.full((len(low), n), -1)
    has[of, word] = np.arange(n)
    told = np.concatenate(swaps + gaps)
    about = word[told[:, 1]]
    missing = (size[about] > 1) & (has[told[:, 0], about] < 0)
    told, about = told[missing], about[missing]
    told = told[np.unique(told[:, 0] * n + about, return_index=True)[1]]
    own = np.where(told[:, 2] < 0, -1, told[:, 2] - first[told[:, 0]])
    theirs = of[told[:, 1]]
    has = has[:, size > 1]
    return np.where(has < 0, -1, has - first[:-1, None]), np.stack([told[:, 0], theirs, told[:, 1] - first[theirs], own], 1)


def _take_turns(word: np.ndarray, of: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]], tangled: np.ndarray) -> None:
    """Words anew where links tie two places of one reading: links that more third readings support come first."""
    some = [(u, v) for x, y in links for k in [np.isin(word[x], tangled)] for u, v in zip(x[k].tolist(), y[k].tolist())]
    beside = defaultdict(set)
    for u, v in some:
        beside[u].add(v)
        beside[v].add(u)
    parts = {u: {int(of[u]): u} for u in beside}
    for u, v in sorted(some, key=lambda e: (-len(beside[e[0]] & beside[e[1]]), e)):
        if parts[u].keys().isdisjoint(parts[v]):
            parts[u].update(parts[v])
            for part in list(parts[v].values()):
                parts[part] = parts[u]
    for u, w in parts.items():
        word[u] = min(w.values())


def consensus(readings: list[list[str]]) -> tuple[list[dict[int, int]], list[tuple[int, str, str]]]:
    """Words that two readings or more have (reading to place), and where a reading has another word (reading, theirs, its own).

    Equal words of two aligned readings are linked; links that more third readings support come first, and a word takes one
    place of a reading at most. A reading without a consensus word has what stands in its place, or nothing: told once a word.
    """
    has, told = _agreed(readings)
    words = [{r: p for r, p in enumerate(w) if p >= 0} for w in has.T.tolist()]
    return words, sorted((r, readings[s][q], "" if p < 0 else readings[r][p]) for r, s, q, p in told.tolist())


@lru_cache(100_000)
def confusions(theirs: str, own: str) -> tuple[tuple[str, str, str], ...]:
    """Runs in which a word differs from another (ins, del or sub; what it should be; what it is)."""
    out = []
    for same, run in groupby(steps(theirs, own), key=lambda s: s[0] == "equal"):
        if not same:
            run = list(run)
            was = "".join(theirs[i] for kind, i, _ in run if kind != "insert")
            now = "".join(own[j] for kind, _, j in run if kind != "delete")
            out.append(("sub" if was and now else "del" if was else "ins", was, now))
    return tuple(out)


def within(p: str, t: str) -> int:
    """What ``distance.infix`` gives: a column of the table at a time as bits of one number."""
    masks: dict[str, int] = {}
    for i, c in enumerate(p):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(p)) - 1, 1 << len(p) >> 1
    up, down, now, best = full, 0, len(p), len(p)
    for c in t:
        e = masks.get(c, 0)
        flat = (((e & up) + up) ^ up) | e | down
        more, less = down | (full & ~(flat | up)), up & flat
        now += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (full & ~(flat | more)), more & flat
        best = min(best, now)
    return best


def within_all(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``within`` of many pairs: those of one number of words of bits side by side, texts of about one length together.

    A text that ends before others goes on with letters that match nothing, which never makes it better.
    """
    out = np.zeros(len(pairs), np.int64)
    words = [-(-len(p) // BITS) for p, _ in pairs]
    order = sorted((k for k, (p, t) in enumerate(pairs) if p not in t), key=lambda k: (words[k], len(pairs[k][1])))
    at = 0
    while at < len(order):
        w, least, to = words[order[at]], len(pairs[order[at]][1]), at + 1
        while to < len(order) and to - at < SIDE and words[order[to]] == w and len(pairs[order[to]][1]) <= least + least // 4 + BITS:
            to += 1
        some = order[at:to]
        out[some] = [within(*pairs[k]) for k in some] if to - at < FEW + 2 * w else _side_by_side([pairs[k] for k in some], w)
        at = to
    return out


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts as numbers, and the texts' lengths."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts])


def _rows(letters: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A column a text, filled up with 0."""
    out = np.zeros((len(lens), int(lens.max())), np.int64)
    out[np.arange(out.shape[1]) < lens[:, None]] = letters
    return np.ascontiguousarray(out.T)


def _side_by_side(pairs: list[tuple[str, str]], words: int) -> np.ndarray:
    """``within`` of pairs whose patterns have so many words of ``BITS`` bits; the bit above them carries."""
    (p, sizes), (t, lens) = (_letters(list(x)) for x in zip(*pairs))
    number = np.zeros(int(max(p.max(), t.max(initial=0))) + 1, np.int64)
    number[p] = 1
    known = np.flatnonzero(number)
    if len(pairs) > 1 and words * len(pairs) * len(known) > TABLE:
        half = len(pairs) // 2
        return np.concatenate([_side_by_side(x, words) for x in (pairs[:half], pairs[half:])])
    number[known] = np.arange(1, len(known) + 1)
    p, t = _rows(number[p], sizes), _rows(number[t], lens)  # 0 matches nothing
    n, kinds = len(pairs), len(known) + 1
    each = np.arange(n) * kinds
    table = np.zeros((words, n * kinds), np.uint64)
    for k, c in enumerate(p + each):
        table[k // BITS][c] |= np.uint64(1 << k % BITS)
    table[:, each] = 0
    full, one, over = np.uint64((1 << BITS) - 1), np.uint64(1), np.uint64(BITS - 1)
    top = ((sizes - 1) % BITS).astype(np.uint64)
    up, down = np.full((words, n), full), np.zeros((words, n), np.uint64)
    e, flat, more, less, x = (np.empty_like(up) for _ in range(5))
    y, best = np.empty(n, np.uint64), sizes.copy()
    now, z = sizes.copy(), np.empty(n, np.int64)
    for c in t + each:
        np.take(table, c, axis=1, out=e, mode="clip")
        np.bitwise_and(e, up, out=flat)
        np.add(flat, up, out=flat)
        for w in range(1, words):
            np.right_shift(flat[w - 1], np.uint64(BITS), out=y)
            np.add(flat[w], y, out=flat[w])
        np.bitwise_xor(flat, up, out=flat)
        np.bitwise_or(flat, e, out=flat)
        np.bitwise_or(flat, down, out=flat)
        np.bitwise_and(flat, full, out=flat)
        np.bitwise_or(flat, up, out=more)
        np.bitwise_xor(more, full, out=more)
        np.bitwise_or(more, down, out=more)
        np.bitwise_and(up, flat, out=less)
        for step, add in ((more, np.add), (less, np.subtract)):
            np.right_shift(step[-1], top, out=y)
            np.bitwise_and(y, one, out=y)
            add(now, y.view(np.int64), out=now)
            np.right_shift(step[:-1], over, out=x[1:])
            np.left_shift(step, one, out=step)
            np.bitwise_or(step[1:], x[1:], out=step[1:])
        np.minimum(best, now, out=best)
        np.bitwise_or(flat, more, out=up)
        np.bitwise_xor(up, full, out=up)
        np.bitwise_or(up, less, out=up)
        np.bitwise_and(up, full, out=up)
        np.bitwise_and(more, flat, out=down)
    return best


class _Votes:
    """Where rare words of one reading, whose codes follow, say that its pieces stand in another."""

    def __init__(self, a: list[str], b: list[str], x: np.ndarray, y: np.ndarray, kinds: int):
        self.a, self.b = a, b
        times = np.bincount(y, minlength=kinds)
        order = np.argsort(y, kind="stable")
        i = np.flatnonzero((times[x] > 0) & (times[x] <= PLACES))
        i = i[np.fromiter((len(a[k]) >= LETTERS for k in i.tolist()), bool, len(i))]
        n = times[x[i]]
        at = np.repeat(i, n)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        shift = order[np.repeat((np.cumsum(times) - times)[x[i]], n) + turn] - at
        self.at, self.shift = at.tolist(), shift.tolist()

    def part(self, start: int, end: int) -> str | None:
        """The words of the other reading about a piece's place, if it has one."""
        lo = bisect_left(self.at, start)
        hi = bisect_left(self.at, end, lo)
        if hi - lo < ANCHORS:
            return None
        votes = sorted(self.shift[lo:hi])
        first = most = to = 0
        for k, v in enumerate(votes):
            while to < len(votes) and votes[to] <= v + BAND:
                to += 1
            if to - k > most:
                first, most = k, to - k
        if most < ANCHORS:
            return None
        at = start + votes[first + most // 2]
        part = self.b[max(at - BESIDE, 0) : max(at + end - start + BESIDE, 0)]
        return " ".join(part) if part else None


def placed_all(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[int, int, int]]:
    """By pair ``placed`` of the first in the second and of the second in the first, one after the other.

    Pieces of all texts, then the halves of those that need it, are compared together.
    """
    votes = []
    for a, b in pairs:
        codes, kinds = pd.factorize(np.array([*a, *b], object))
        x, y = codes[: len(a)], codes[len(a) :]
        votes += [_Votes(a, b, x, y, len(kinds)), _Votes(b, a, y, x, len(kinds))]
    level = [(k, start, min(start + CHUNK, len(v.a))) for k, v in enumerate(votes) for start in range(0, len(v.a), CHUNK)]
    levels = []
    while level:
        texts = [" ".join(votes[k].a[start:end]) for k, start, end in level]
        parts = [votes[k].part(start, end) for k, start, end in level]
        edits = iter(within_all([(t, p) for t, p in zip(texts, parts) if p is not None]).tolist())
        e = [None if p is None else next(edits) for p in parts]
        cut = [(x is None or x / len(t) > HALVE) and end - start >= 2 * LEAST for t, x, (_, start, end) in zip(texts, e, level)]
        levels.append((level, [len(t) for t in texts], e, cut))
        level = [(k, *ends) for c, (k, start, end) in zip(cut, level) if c for ends in ((start, (start + end) // 2), ((start + end) // 2, end))]
    below: list[tuple[int, int]] = []  # letters with a place and their edits
    for _, sizes, edits, cut in reversed(levels):
        halves, found = iter(below), []
        for n, e, c in zip(sizes, edits, cut):
            rate = None if e is None else e / n
            whole = (n, e) if rate is not None and rate <= LOST else (0, 0)
            if c:
                (c, e), (d, f) = next(halves), next(halves)
                letters = c + d + bool(c and d)  # the blank between
                if not whole[0] or letters and (e + f) / letters < rate:
                    whole = letters, e + f
            found.append(whole)
        below = found
    out = [(0, 0, 0)] * len(votes)
    if levels:
        for (k, _, _), n, (c, e) in zip(levels[0][0], levels[0][1], below):
            letters, matched, edits = out[k]
            out[k] = letters + n, matched + c, edits + e
    return out


def placed(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Letters of ``a`` in chunks, those that have a place in ``b``, and their edits there."""
    return placed_all([(a, b)])[0]


def agreement(a: str | None, b: str | None) -> dict[str, float | None]:
    """How much of each reading the other has as a bag and in place, and how they differ where both have the text.

    A share of nothing is null; null texts are empty.
    """
    return agreements([(a, b)])[0]


def agreements(pairs: list[tuple[str | None, str | None]]) -> list[dict[str, float | None]]:
    """``agreement`` of many pairs."""
    pairs = [(normalise(a or ""), normalise(b or "")) for a, b in pairs]
    split = [(a.split(), b.split()) for a, b in pairs]
    found = placed_all(split)
    share = lambda n, of: round(n / of, 6) if of else None
    out = []
    for (a, b), (la, ma, ea), (lb, mb, eb) in zip(pairs, found[::2], found[1::2]):
        x, y = (Counter(re.findall(r"[^\W_]+", t.lower())) for t in (a, b))
        both = (x & y).total()
        out.append({
            "cover_a": share(both, x.total()), "cover_b": share(both, y.total()), "len_ratio": share(len(b), len(a)), "matched_a": share(ma, la), "matched_b": share(mb, lb),
            "local_cer_a": share(ea, ma), "local_cer_b": share(eb, mb), "local_cer_sym": share(ea + eb, ma + mb),
        })
    return out


MEASURES = ("cover_a", "cover_b", "len_ratio", "matched_a", "matched_b", "local_cer_a", "local_cer_b", "local_cer_sym")


def agreement_of(a: Column, b: Column) -> Column:
    """``agreement`` of two columns as a struct."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out, some, size = [], [], 0
        for pair in zip(x, y):
            some.append(pair)
            size += sum(len(t or "") for t in pair)
            if size >= TOGETHER:
                out += agreements(some)
                some, size = [], 0
        return pd.DataFrame([*out, *agreements(some)], columns=list(MEASURES), dtype="float64")

    return F.pandas_udf(run, ", ".join(f"{m} double" for m in MEASURES))(a, b)


def consensus_of(*readings: Column) -> Column:
    """``consensus`` of a page's readings: words, and per reading its words and those in the consensus."""

    def run(*texts: pd.Series) -> pd.DataFrame:
        rows = []
        for page in zip(*texts):
            own = [printed_words(t) for t in page]
            has = _agreed(own)[0]
            rows.append((has.shape[1], [len(w) for w in own], (has >= 0).sum(1).tolist()))
        return pd.DataFrame(rows, columns=["words", "own", "held"])

    return F.pandas_udf(run, "words int, own array<int>, held array<int>")(*readings)


def confusions_of(pages: DataFrame, *readings: Column) -> DataFrame:
    """How often each confusion occurs in ``consensus`` of all pages: reader, kind, was, now, n.

    A task counts differing words before it cuts them into runs, and hands over its counts whenever it holds many.
    """

    def counted(words: Counter) -> pa.RecordBatch:
        runs = Counter()
        for (r, theirs, own), n in words.items():
            for c in confusions(theirs, own):
                runs[r, *c] += n
        columns = list(zip(*runs)) or [()] * 4
        return pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.string()) for c in columns[1:]), pa.array(list(runs.values()), pa.int64())], ["reader", "kind", "was", "now", "n"])

    def run(batches):
        words = Counter()
        for batch in batches:
            for page in zip(*(c.to_pylist() for c in batch.columns)):
                own = [printed_words(t) for t in page]
                words.update((r, own[s][q], "" if p < 0 else own[r][p]) for r, s, q, p in _agreed(own)[1].tolist())
                if len(words) >= HELD:
                    yield counted(words)
                    words = Counter()
        yield counted(words)

    parts = pages.select(*(c.alias(f"r{k}") for k, c in enumerate(readings))).mapInArrow(run, "reader int, kind string, was string, now string, n long")
    return parts.groupBy("reader", "kind", "was", "now").agg(F.sum("n").alias("n"))
