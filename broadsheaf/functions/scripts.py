"""Japanese and Latin parts of a page's text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MAX_TOKEN_CHARS, fold, rejoined

WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
#: Marks and blocks whose characters are words of their own.
JAPANESE = ((0x3005, 0x3007), (0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x2FA1F))
VOICING = "゙゚ﾞﾟ"


def _large() -> dict[str, str]:
    """Small kana and their large forms, from the Unicode names."""
    out = {}
    for c in map(chr, [*range(0x3041, 0x3097), *range(0x30A1, 0x30FB)]):
        name = unicodedata.name(c)
        if " SMALL " in name:
            out[c] = unicodedata.lookup(name.replace(" SMALL", ""))
    return out


LARGE = _large()


def is_japanese(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in JAPANESE)


def japanese_char(c: str, newer: dict[str, str]) -> str:
    """A character with its full width, unified, modern (by ``newer``) and large form."""
    form = unicodedata.normalize("NFKC" if "ｦ" <= c <= "ﾟ" else "NFC", c)
    c = form if len(form) == 1 else c
    c = newer.get(c, c)
    return LARGE.get(c, c)


def japanese_tokens(text: str, newer: dict[str, str] | None = None) -> list[tuple[str, int, int]]:
    """Words with their places: each Japanese character is one (with a voicing mark after it), a run of others is folded.

    ``newer`` maps older forms of characters to those of today. Marks without a character and runs of more than 40 letters are
    left out.
    """
    out, i, n = [], 0, len(text)
    while i < n:
        start, c = i, text[i]
        i += 1
        if c in VOICING or not c.isalnum() and not is_japanese(c):
            continue
        if is_japanese(c):
            if i < n and text[i] in VOICING:
                whole = unicodedata.normalize("NFKC", c + text[i].translate({0xFF9E: 0x3099, 0xFF9F: 0x309A}))
                if len(whole) == 1:
                    c, i = whole, i + 1
            if c.isalnum():
                out.append((japanese_char(c, newer or {}), start, i))
            continue
        while i < n and text[i].isalnum() and not is_japanese(text[i]):
            i += 1
        word = fold(text[start:i])
        if 0 < len(word) <= MAX_TOKEN_CHARS:
            out.append((word, start, i))
    return out


def find(text: str, phrases: list[list[str]], newer: dict[str, str] | None = None) -> list[tuple[int, int]]:
    """Where phrases stand in a text, in order; what touches is one."""
    words = japanese_tokens(text, newer)
    hits = sorted((words[i][1], words[i + len(p) - 1][2]) for p in phrases if p for i in range(len(words) - len(p) + 1) if [w for w, _, _ in words[i : i + len(p)]] == p)
    out: list[tuple[int, int]] = []
    for a, b in hits:
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def snippets(text: str, phrases: list[list[str]], context: int, most: int, newer: dict[str, str] | None = None) -> list[list[tuple[bool, str]]]:
    """Up to ``most`` fragments around matches as (matches, text); a match within twice the context of a fragment's first is part of it."""
    flat, free = text.replace("\n", " "), 0
    hits: Iterator[tuple[int, int]] | list = find(text, phrases, newer)
    out = []
    while hits and len(out) < most:
        if hits[0][0] < free:
            hits = hits[1:]
            continue
        near = [h for h in hits if h[0] < hits[0][0] + 2 * context]
        hits = hits[len(near) :]
        at, parts = max(near[0][0] - context, free), []
        for a, b in near:
            parts += [(False, flat[at:a]), (True, flat[a:b])]
            at = b
        free = min(at + context, len(flat))
        out.append([p for p in [*parts, (False, flat[at:free])] if p[1]])
    return out


def japanese_words(text: Column, newer: dict[str, str] | None = None) -> Column:
    """The words of ``japanese_tokens`` as an array; null texts stay null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [w for w, _, _ in japanese_tokens(t, newer)])

    return F.pandas_udf(run, "array<string>")(text)


def latin_text(text: Column) -> Column:
    """The runs of Latin script with two letters or more, a line per line; full-width forms are narrowed."""
    lines = F.split(F.translate(text, WIDE, NARROW), "\n")
    letters = lambda r: F.length(F.regexp_replace(r, r"\P{L}", ""))
    bare = lambda r: F.regexp_replace(r, r"^\p{Z}+|\p{Z}+$", "")
    runs = lambda line: F.filter(F.regexp_extract_all(line, F.lit(r"([\x20-\x7E\u00A0-\u024F\u2010-\u205E]+)"), 1), lambda r: letters(r) >= 2)
    kept = F.filter(F.transform(lines, lambda line: F.array_join(F.transform(runs(line), bare), " ")), lambda line: line != "")
    return rejoined(F.replace(F.array_join(kept, "\n"), F.lit("ſ"), F.lit("s")))
