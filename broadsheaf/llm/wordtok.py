"""Encoding of whole texts with a word-level BPE tokenizer, vectorised over a batch.

The tokenizer lower-cases, drops white space and merges only inside a pre-token (a run of letters, one
digit, a run of other characters, an English contraction). So a text's ids are those of its pre-tokens in
order, and each distinct pre-token of a batch is merged once: all pairs of all distinct pre-tokens are looked
up at a time and each takes its best merge, until none has one. Texts with characters from U+0180 on (where
normalisation and casing depend on neighbours) and very long pre-tokens go to the library itself.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import ranges, spans

#: From this code point on a text goes to the library.
SIMPLE = 0x180
#: Bytes of a pre-token from which on it goes to the library.
LONG = 48
NONE = np.uint32(0xFFFFFFFF)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(256 + extra)
        extra += b not in plain
    return out


class Encoder:
    """Per-process encoder; ``encode`` gives flat ids (and character spans) for an array of texts."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end, letters = model["vocab"], model["end_of_word_suffix"], _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.uint32)
        self.last = np.array([vocab[x + end] for x in letters], dtype=np.uint32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] if not a.endswith(end) else -1 for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order].astype(np.uint32), order.astype(np.uint32), made[order].astype(np.uint32)
        self._hash()
        kinds = np.zeros(SIMPLE, dtype=np.uint8)  # 0 other, 1 letter, 2 number, 3 space
        for c in range(SIMPLE):
            kinds[c] = 1 if regex.match(r"\p{L}", chr(c)) else 2 if regex.match(r"\p{N}", chr(c)) else 3 if chr(c) in "\t\n\v\f\r \x85\xa0" else 0
        self.kinds = kinds
        self.hard = np.zeros(256, dtype=bool)
        self.hard[0x1C:0x20] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _hash(self) -> None:
        """Two tables from a hash of the pair to its place in ``keys``; the second has what collides in the first."""
        self.odd = [0x9E3779B1, 0x85EBCA6B]
        size = 1 << (20 if len(self.keys) < 1 << 17 else 24)
        self.down = np.uint32(32 - size.bit_length() + 1)
        left = np.arange(len(self.keys))
        self.tables = []
        for odd in self.odd:
            t = np.zeros(size, dtype=np.int32)
            h = (self.keys[left] * np.uint32(odd)) >> self.down
            t[h] = left
            self.tables.append(t)
            left = left[t[h] != left]
        self.rest = self.keys[left]  # nearly always empty
        self.rest_at = left

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.tables[0][(key * np.uint32(self.odd[0])) >> self.down]
        found = self.keys[at] == key
        no = np.flatnonzero(~found)
        other = self.tables[1][(key[no] * np.uint32(self.odd[1])) >> self.down]
        hit = self.keys[other] == key[no]
        at[no[hit]] = other[hit]
        found[no[hit]] = True
        for k, i in zip(self.rest, self.rest_at):
            same = key == k
            at[same], found = i, found | same
        return at, found

    def _merge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, ids per piece and bytes per id, of pieces that lie one after the other in ``data``."""
        n = len(bounds) - 1
        sym = self.inner[data]
        sym[bounds[1:] - 1] = self.last[data[bounds[1:] - 1]]
        width = np.ones(len(sym), dtype=np.int32)
        piece = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            at, found = self._find(sym[:-1] << np.uint32(16) | sym[1:])
            rank = np.where(found & (piece[1:] == piece[:-1]), self.ranks[at], NONE)
            rank = np.append(rank, NONE)
            first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            best = np.minimum.reduceat(rank, first)
            runs = np.diff(np.append(first, len(sym)))
            live = best != NONE
            still = np.repeat(live, runs)
            if not still.all():
                done.append((piece[~still], sym[~still], width[~still]))
                at = np.append(at, 0)[still]
                sym, width, piece, rank = sym[still], width[still], piece[still], rank[still]
                best, runs = best[live], runs[live]
                if not len(sym):
                    break
            else:
                at = np.append(at, 0)
            hit = rank == np.repeat(best, runs)
            twice = np.flatnonzero(hit[1:] & hit[:-1])
            if len(twice):  # overlapping pairs of one letter: every other one of a run, from the left
                spot = np.flatnonzero(hit)
                fresh = np.append(True, np.diff(spot) != 1)
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
                hit[spot[(np.arange(len(spot)) - start) % 2 == 1]] = False
            where = np.flatnonzero(hit)
            sym[where] = self.made[at[where]]
            width[where] += width[where + 1]
            keep = np.ones(len(sym), dtype=bool)
            keep[where + 1] = False
            sym, width, piece = sym[keep], width[keep], piece[keep]
        if not done:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64), np.zeros(0, np.int32)
        p, s, w = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(p, kind="stable")
        return s[order], np.bincount(p, minlength=n), w[order]

    def _pieces(self, pieces: pa.Array, spots: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, ids per piece, and for each id its first and last character (exclusive) within its piece."""
        size = np.asarray(pc.binary_length(pieces), dtype=np.int64)
        data = np.frombuffer(pieces.cast(pa.large_string()).buffers()[2] or b"", dtype=np.uint8)
        offs = np.frombuffer(pieces.cast(pa.large_string()).buffers()[1], dtype=np.int64)[: len(pieces) + 1]
        short = size <= LONG
        some = np.flatnonzero(short)
        data_s = data[ranges(offs[:-1][some], size[some])]
        ids, count, width = self._merge(data_s, spans(size[some]))
        counts = np.zeros(len(pieces), dtype=np.int64)
        counts[some] = count
        # bytes to characters: a token that holds part of a character has the whole character
        if not spots and short.all():
            return ids, counts, ids, ids
        lead = np.cumsum((data_s & 0xC0) != 0x80)
        b0 = spans(width)[:-1]
        base = np.repeat(lead[spans(size[some])[:-1]] if len(some) else np.zeros(0, np.int64), count)
        begin = lead[b0] - base if len(b0) else b0
        finish = lead[b0 + width - 1] - base + 1 if len(b0) else b0
        rest = np.flatnonzero(~short)
        if not len(rest):
            return ids, counts, begin, finish
        got = self.tok.encode_batch(pieces.take(pa.array(rest)).to_pylist(), add_special_tokens=False)
        counts[rest] = [len(e.ids) for e in got]
        at = spans(counts)
        out = [np.zeros(at[-1], dtype=np.int64) for _ in range(3)]
        place = ranges(at[:-1][some], count)
        for o, v in zip(out, (ids, begin, finish)):
            o[place] = v
        for i, e in zip(rest, got):
            out[0][at[i] : at[i + 1]] = e.ids
            span = np.asarray(e.offsets, dtype=np.int64).reshape(-1, 2)
            out[1][at[i] : at[i + 1]], out[2][at[i] : at[i + 1]] = span[:, 0], span[:, 1]
        return out[0], counts, out[1], out[2]

    def encode(self, texts: pa.Array, spots: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Flat ids (uint32), offsets (n + 1) by text, and with ``spots`` each id's first and last character (exclusive) in its text."""
        every = texts.to_pylist()
        n = len(every)
        size = np.fromiter(map(len, every), dtype=np.int64, count=n)
        joined = "\n".join(every) + "\n"
        cp = self._points(joined)
        at = spans(size + 1)
        odd = self.hard[cp] if cp.dtype == np.uint8 else (cp >= SIMPLE) | (cp == 0x130) | ((cp >= 0x1C) & (cp <= 0x1F))
        slow = np.add.reduceat(odd, at[:-1], dtype=np.int64) > 0 if n and odd.any() else np.zeros(n, dtype=bool)
        if slow.any():
            every = ["" if s else t for s, t in zip(slow, every)]
            size = np.where(slow, 0, size)
            joined = "\n".join(every) + "\n"
            at = spans(size + 1)
        low = joined.lower()
        cp = self._points(low)
        kind = self.kinds[cp]
        start = np.empty(len(kind), dtype=bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[1:] |= kind[1:] == 2
        quote = np.flatnonzero((cp[:-1] == 39) & (kind[1:] == 1) & start[:-1])  # alone before a letter
        if len(quote):
            pad = np.append(cp, [10, 10, 10])
            a, b = pad[quote + 1], pad[quote + 2]
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for which, w in ((one, 2), (two, 3)):
                q = quote[which]
                start[q + 1] = False
                start[np.minimum(q + w, len(start) - 1)] = True
        begin = np.flatnonzero(start)
        solid = kind[begin] != 3
        data = low.encode()
        wide = np.flatnonzero(cp >= 0x80)  # two bytes each
        offs = np.append(begin, len(cp))
        offs = offs + np.searchsorted(wide, offs)
        pieces = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data))
        coded = pieces.filter(pa.array(solid)).dictionary_encode()
        index = np.asarray(coded.indices, dtype=np.int64)
        begin = begin[solid]
        ids, count, first, last = self._pieces(coded.dictionary, spots)
        home = spans(count)
        per = count[index]
        take = ranges(home[:-1][index], per)
        bound = spans(per)[np.searchsorted(begin, at)]
        flat = ids[take].astype(np.uint32)
        if spots:
            shift = np.repeat(begin, per) - np.repeat(at[:-1], np.diff(bound))
            first, last = first[take] + shift, last[take] + shift
        if slow.any():
            flat, bound, first, last = self._with_slow(texts, slow, flat, bound, first, last, spots)
        return (flat, bound, first, last) if spots else (flat, bound, None, None)

    @staticmethod
    def _points(text: str) -> np.ndarray:
        try:
            return np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
        except UnicodeEncodeError:
            return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    def _with_slow(self, texts, slow, flat, bound, first, last, spots):
        """The results with those of the texts that only the library encodes, in their places."""
        where = np.flatnonzero(slow)
        got = self.tok.encode_batch(texts.take(pa.array(where)).to_pylist(), add_special_tokens=False)
        extra, counts, parts = {int(i): e for i, e in zip(where, got)}, np.diff(bound), []
        for i in range(len(texts)):
            if i in extra:
                span = np.asarray(extra[i].offsets, dtype=np.int64).reshape(-1, 2)
                parts.append((np.asarray(extra[i].ids, dtype=np.uint32), span[:, 0], span[:, 1]))
                counts[i] = len(span)
            else:
                s = slice(bound[i], bound[i + 1])
                parts.append((flat[s], first[s], last[s]) if spots else (flat[s], first[:0], last[:0]))
        flat, first, last = (np.concatenate(x) for x in zip(*parts))
        return flat, spans(counts), first, last
