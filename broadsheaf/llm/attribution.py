"""Token counts by section: whole documents are encoded once and token spans are joined to section spans.

A section is a span [from, to) of characters. Each token is a span as well, and the interval join of both is
done per document by binary search over sorted spans. The rule for a token that crosses a boundary is explicit:

* ``first`` — the section that holds its first character has the whole token;
* ``most`` — the section with most of its characters has it, the earlier one on ties;
* ``share`` — each section has the part of the token that its characters are.

Characters that no section covers are counted under section -1. Defined cases: null and empty texts have no
sections and no tokens and give one row with section -1; repeated rows give repeated results; an empty table an
empty one; sections of one document must not overlap; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, spans, texts, tune
from .wordtok import Encoder, default_path

COUNTS = "doc_id long, section int, begin long, finish long, n_tokens long, n_crossing long, tokens double"
RULES = ("first", "most", "share")


def sentences(text: str) -> np.ndarray:
    """Ends of the default sections: after each '.', '!', '?' or line feed, and at the end of the text.

    A run such as '...' or '.,' is one token of the tokenizer, so tokens do cross these boundaries.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero((cp == 46) | (cp == 33) | (cp == 63) | (cp == 10)) + 1
    return ends if len(ends) and ends[-1] == len(cp) else np.append(ends, len(cp)) if len(cp) else ends


def attribute(first: np.ndarray, last: np.ndarray, begin: np.ndarray, finish: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: whole tokens, crossing tokens and (shared) tokens by section; the last place is "no section".

    ``first``/``last``: token spans in order. ``begin``/``finish``: sorted section spans that do not overlap.
    """
    n = len(begin)
    count, cross, share = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1)
    if not len(first):
        return count, cross, share
    a = np.searchsorted(finish, first, side="right")  # the first section that ends after the token begins
    b = np.searchsorted(begin, last, side="left")  # the first section that begins at its end or later
    width = np.maximum(last - first, 1)
    pieces = np.maximum(b - a, 0)
    token = np.repeat(np.arange(len(first)), pieces)
    section = np.arange(len(token)) - np.repeat(spans(pieces)[:-1], pieces) + np.repeat(a, pieces)
    part = np.minimum(last[token], finish[section]) - np.maximum(first[token], begin[section]) if len(token) else np.zeros(0, np.int64)
    token, section, part = token[part > 0], section[part > 0], part[part > 0]
    covered = np.bincount(token, part, minlength=len(first)).astype(np.int64)
    bare = width - covered
    holds = np.bincount(token, minlength=len(first)) + (bare > 0)
    several = holds[token] > 1
    cross[:n] = np.bincount(section[several], minlength=n)
    cross[n] = int(((holds > 1) & (bare > 0)).sum())
    share[:n] = np.bincount(section, part / width[token], minlength=n)
    share[n] = float((bare / width).sum())
    owner = np.full(len(first), n)
    if rule == "most":
        owner[token[~several]] = section[~several]
        t, s, p = token[several], section[several], part[several]  # of a crossing token its largest part, the earlier one on ties
        order = np.lexsort((s, -p, t))
        t, s, p = t[order], s[order], p[order]
        best = np.append(True, t[1:] != t[:-1])[: len(t)] & (p >= bare[t])
        owner[t[best]] = s[best]
    else:
        inside = (a < n) & (begin[np.minimum(a, n - 1)] <= first) if n else np.zeros(len(first), bool)
        owner[inside] = a[inside]
    count += np.bincount(owner, minlength=n + 1)
    return count, cross, share if rule == "share" else count.astype(float)


def token_counts(docs: DataFrame, rule: str = "most", tokenizer: str | None = None, cut: Callable[[str], np.ndarray] = sentences, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and section (and per document one for what is outside): whole and shared token counts.

    ``cut`` gives the ends of the sections of a text; they lie gapless from its start.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path)
        for batch in batches:
            for part in slices(batch):
                _, at, first, last = enc.encode(part.column("text"))
                all_texts = part.column("text").to_pylist()
                ends = [cut(t) for t in all_texts]
                n = np.array([len(e) for e in ends], dtype=np.int64)
                size = np.array([len(t) for t in all_texts], dtype=np.int64)
                # one axis for the whole slice: a gap of one between texts keeps their spans apart
                base = spans(size + 1)[:-1]
                doc = np.repeat(np.arange(len(n)), n)
                finish = np.concatenate(ends).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
                lead = np.append(0, finish[:-1]) if len(doc) else finish
                heads = spans(n)[:-1][n > 0]
                lead[heads] = 0
                shift = np.repeat(base, np.diff(at))
                count, cross, share = attribute(first + shift, last + shift, lead + base[doc], finish + base[doc], rule)
                # what no section covers, by document: all sections here are gapless, so only texts without one
                none = np.flatnonzero(n == 0)
                order = np.argsort(np.append(doc, none), kind="stable")
                pad = lambda x, v=0: np.append(x, np.full(len(none), v, dtype=x.dtype))[order]
                section = np.arange(len(doc)) - np.repeat(spans(n)[:-1], n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(np.append(doc, none)[order])), pa.array(pad(section, -1), pa.int32()), *(pa.array(pad(x)) for x in (lead, finish, count[:-1], cross[:-1], share[:-1]))],
                    names=["doc_id", "section", "begin", "finish", "n_tokens", "n_crossing", "tokens"],
                )

    tune(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, COUNTS)
