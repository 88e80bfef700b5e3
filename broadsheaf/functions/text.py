"""Text functions: folding, tokens, status, snippets; built-in expressions first, exact Unicode forms as pandas UDFs."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_PAGE_CHARS, MAX_TOKEN_CHARS, GAP = 20, 40, "_"
#: Letters without a decomposition and what they fold to.
TRANSLITERATED = {"ſ": "s", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ŋ": "ng", "ħ": "h"}


def _marked() -> tuple[str, str]:
    """Precomposed Latin letters and their bare forms, from the Unicode tables."""
    have, bare = [], []
    for c in map(chr, [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and base.isascii() and c == c.lower():
            have.append(c)
            bare.append(base)
    return "".join(have), "".join(bare)


HAVE, BARE = _marked()


def folded(text: Column) -> Column:
    """Lower case without marks, transliterated: the built-in form, exact for precomposed Latin letters."""
    out = F.translate(F.lower(text), HAVE, BARE)
    for a, b in TRANSLITERATED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(F.lower(text))  # plain texts need no folding


def words(text: Column) -> Column:
    """Folded tokens in order, each between blanks (`` the cross of gold ``): what predicates are matched on.

    Tokens of more than 40 characters leave a gap, so no phrase bridges them.
    """
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.regexp_replace(flat, r"(?<= )[^ ]{%d,}(?= )" % (MAX_TOKEN_CHARS + 1), GAP)


def tokens(text: Column) -> Column:
    """The tokens as an array, gaps left out."""
    return F.filter(F.split(words(text), " "), lambda t: (t != "") & (t != GAP))


def text_status(text: Column) -> Column:
    """empty: no character but white space; short: under 20 characters when trimmed; else ok."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(F.length(bare) == 0, "empty").when(F.length(bare) < MIN_PAGE_CHARS, "short").otherwise("ok")


def rejoined(text: Column) -> Column:
    """Words broken by a hyphen at a line's end made whole again, other white space collapsed; line ends stay."""
    out = F.regexp_replace(text, r"(\p{L})-[ \t]*\n\s*(\p{L})", "$1$2")
    out = F.regexp_replace(F.regexp_replace(out, r"[^\S\n]+", " "), r" ?\n\s*", "\n")
    return F.trim(out)


#: Ligatures that are spelt out.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

#: All of category Cc but tabs and line ends.
CONTROLS = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")


def normalise(raw: str | None, fraktur: bool = False, japanese: bool = False) -> str | None:
    """NFC; long s; controls dropped; ligatures; broken words rejoined; white space collapsed with single line ends."""
    if raw is None:
        return None
    t = unicodedata.normalize("NFC", raw).replace("ſ", "s")
    t = CONTROLS.sub("", t)
    for a, b in LIGATURES.items():
        t = t.replace(a, b)
    marks = "-" if japanese else "-⸗¬‐"
    t = re.sub(rf"[{marks}](?<=[^\W\d_].)[ \t]*\n\s*(?=[^\W\d_])", "", t)
    if fraktur:
        t = re.sub(r"(?<=[^\W\d_])—[ \t]*\n\s*(?=[a-zäöüß])", "", t)
    t = re.sub(r"[^\S\n]{2,}|[^\S\n ]", " ", t)  # all but single blanks
    return re.sub(r" ?\n\s*", "\n", t).strip()


def fold(token: str) -> str:
    """One token, exactly: compatibility decomposition without marks, lower case, transliterated."""
    t = unicodedata.normalize("NFKD", token.replace("Ŀ", "l").replace("ŀ", "l"))
    t = "".join(c for c in t if not unicodedata.combining(c)).lower()
    return "".join(TRANSLITERATED.get(c, c) for c in t)


def tokenise(text: str) -> list[str]:
    """Folded tokens in order, ``_`` for one of more than 40 characters."""
    out = [fold(t) for t in re.findall(r"[^\W_]+", text)]
    return [t if len(t) <= MAX_TOKEN_CHARS else GAP for t in out if t]


def _normalised(raw: pd.Series) -> pd.Series:
    return raw.map(normalise)


def _exact_words(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else f" {' '.join(tokenise(t))} ")


def normalised(text: Column) -> Column:
    """``normalise`` as a vectorised function."""
    return F.pandas_udf(_normalised, "string")(text)


def exact_words(text: Column) -> Column:
    """What ``words`` gives, for any script."""
    return F.pandas_udf(_exact_words, "string")(text)


def snippets(text: str, wanted: set[str], context: int = 80, most: int = 3) -> list[str]:
    """Fragments around matching tokens with ``<mark>``; nearby matches share one, and edges are told by dots."""
    spots = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if fold(m.group()) in wanted]
    parts: list[list] = []
    for a, b in spots:
        if parts and a - parts[-1][-1][1] <= context:
            parts[-1].append((a, b))
        else:
            parts.append([(a, b)])
    out = []
    for part in parts[:most]:
        begin, end = max(0, part[0][0] - context), min(len(text), part[-1][1] + context)
        if begin:
            begin += re.match(r"\w*\W*", text[begin:]).end() if text[begin - 1].isalnum() and begin < part[0][0] else 0
            begin = min(begin, part[0][0])
        s, at = "", begin
        for a, b in part:
            s += html.escape(text[at:a], quote=False) + "<mark>" + html.escape(text[a:b], quote=False) + "</mark>"
            at = b
        s += html.escape(text[at:end], quote=False)
        out.append(("… " if begin else "") + " ".join(s.split()) + (" …" if end < len(text) else ""))
    return out


def snippet_udf(wanted: set[str], context: int = 80):
    held = frozenset(wanted)

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: snippets(t, held, context) if t else [])

    return F.pandas_udf(run, "array<string>")


def opening(text: Column, size: int = 160) -> Column:
    """The first characters of a text, cut at a word."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_extract(F.substring(flat, 1, size + 1), r"^(.*)\s\S*$", 1)
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.when(cut == "", F.substring(flat, 1, size)).otherwise(cut), F.lit(" …")))
