"""The page-search language: a small tree, its parser, canonical form and translation to a column.

Bare words are joined by AND; ``"..."`` is a phrase and ``"..."~n`` words near each other; ``OR``, ``NOT`` or a leading ``-``;
``word*`` and ``?``/``*`` inside a word (after five letters); ``word~n`` by edit distance; ``word~ocr`` by common misreadings;
``N OF (a b c)``. The column is matched on the folded words of a page (see ``functions.text.words``), inside code generation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scripts import is_japanese
from ..functions.text import tokenise

MAX_QUERY, MAX_SLOP, MIN_PREFIX, MAX_OF, MAX_SPELLINGS = 256, 20, 5, 6, 32
#: Letter groups that are misread for each other.
CONFUSIONS = (("h", "li"), ("m", "rn"), ("e", "c"), ("th", "tb"), ("s", "f"), ("n", "u"), ("i", "l"), ("d", "cl"), ("w", "vv"))
#: Fractions that print both as one sign and as figures.
FRACTIONS = {"½": "1 2", "⅓": "1 3", "⅔": "2 3", "¼": "1 4", "¾": "3 4", "⅛": "1 8", "⅜": "3 8", "⅝": "5 8", "⅞": "7 8"}


class QueryError(ValueError):
    def __init__(self, why: str, position: int = 0):
        super().__init__(f"{why} (at {position})")
        self.position = position


@dataclass(frozen=True)
class Term:
    text: str
    fuzzy: int = 0
    ocr: bool = False

    @property
    def wild(self) -> bool:
        return "*" in self.text or "?" in self.text

    def __str__(self) -> str:
        return self.text + (f"~{self.fuzzy}" if self.fuzzy else "~ocr" if self.ocr else "")


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    slop: int = 0

    def __str__(self) -> str:
        return f'"{" ".join(self.terms)}"' + (f"~{self.slop}" if self.slop else "")


@dataclass(frozen=True)
class And:
    of: tuple

    def __str__(self) -> str:
        return " ".join(sorted(_inner(x) for x in self.of))


@dataclass(frozen=True)
class Or:
    of: tuple

    def __str__(self) -> str:
        return " OR ".join(sorted(_inner(x) for x in self.of))


@dataclass(frozen=True)
class AtLeast:
    min: int
    of: tuple

    def __str__(self) -> str:
        return f"{self.min} OF ({' '.join(sorted(str(x) for x in self.of))})"


@dataclass(frozen=True)
class Not:
    of: object

    def __str__(self) -> str:
        return f"NOT {_inner(self.of)}"


def _inner(node) -> str:
    return f"({node})" if isinstance(node, And | Or) else str(node)


def spellings(word: str) -> list[str]:
    """The word and every spelling with exactly one group misread, in order, at most 32."""
    out = {word}
    for pair in CONFUSIONS:
        for a, b in (pair, pair[::-1]):
            out |= {word[: m.start()] + b + word[m.start() + len(a) :] for m in re.finditer(f"(?={a})", word)}
    return [word, *sorted(out - {word})][:MAX_SPELLINGS]


TOKEN = re.compile(r'\s*(?:(?P<phrase>"(?P<body>[^"]*)"(?:~(?P<slop>\d+))?)|(?P<of>(?P<n>\d+)\s+OF\s*\()|(?P<open>\()|(?P<close>\))|(?P<minus>-(?=\S))|(?P<word>[^\s()"]+))')


class Parser:
    def __init__(self, text: str):
        if len(text) > MAX_QUERY:
            raise QueryError(f"longer than {MAX_QUERY} characters")
        self.parts, at = [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError("an open quote", at)
            self.parts.append(m)
            at = m.end()
        self.i = 0

    def kind(self) -> str:
        if self.i >= len(self.parts):
            return "end"
        m = self.parts[self.i]
        if m["word"] in ("OR", "NOT", "AND"):
            return m["word"]
        return next(k for k in ("phrase", "of", "open", "close", "minus", "word") if m[k])

    def any_of(self):
        out = [self.all_of()]
        while self.kind() == "OR":
            self.i += 1
            out.append(self.all_of())
        return out[0] if len(out) == 1 else Or(tuple(out))

    def all_of(self):
        out = []
        while self.kind() not in ("end", "close", "OR"):
            if self.kind() == "AND":
                self.i += 1
                continue
            out.append(self.one())
        if not out:
            raise QueryError("nothing to search", self.parts[self.i].start() if self.i < len(self.parts) else 0)
        if all(isinstance(x, Not) for x in out):
            raise QueryError("only exclusions")
        return out[0] if len(out) == 1 else And(tuple(out))

    def one(self):
        kind, m = self.kind(), self.parts[self.i]
        self.i += 1
        if kind in ("minus", "NOT"):
            return Not(self.one())
        if kind == "open":
            node = self.any_of()
            self.shut()
            return node
        if kind == "of":
            items = []
            while self.kind() not in ("end", "close"):
                items.append(self.one())
            self.shut()
            n = int(m["n"])
            if not 2 <= n < len(items) or len(items) > MAX_OF or not all(isinstance(x, Term | Phrase) for x in items):
                raise QueryError(f"N OF takes words or phrases: 2 or more of at most {MAX_OF}, and more than N", m.start())
            return AtLeast(n, tuple(items))
        if kind == "phrase":
            terms = tuple(tokenise(m["body"]))
            slop = int(m["slop"] or 0)
            if not terms or slop > MAX_SLOP:
                raise QueryError("an empty phrase" if not terms else f"words may be at most {MAX_SLOP} apart", m.start())
            return Term(terms[0]) if len(terms) == 1 else Phrase(terms, slop)
        if kind == "word":
            return self.word(m["word"], m.start("word"))
        raise QueryError("a part is missing", m.start())

    def shut(self) -> None:
        if self.kind() != "close":
            raise QueryError("a bracket is not closed")
        self.i += 1

    @staticmethod
    def word(w: str, at: int):
        if re.match(r"\w+:", w):
            raise QueryError("fields cannot be named", at)
        base, _, mark = w.partition("~")
        base = re.sub(r"[?]+$", "", base)  # an ending question mark is punctuation
        if "*" in base or "?" in base:
            if mark or not re.match(r"\w{%d,}" % MIN_PREFIX, base):
                raise QueryError(f"* and ? follow at least {MIN_PREFIX} letters, without ~", at)
            return Term("".join(c if c in "*?" else "".join(tokenise(c)) for c in base))
        terms = tokenise(base)
        if not terms:
            raise QueryError("no letters or figures", at)
        if len(terms) > 1:
            return Phrase(tuple(terms))
        if mark == "ocr":
            return Term(terms[0], ocr=True)
        if mark and mark not in ("1", "2"):
            raise QueryError("~ takes 1, 2 or ocr", at)
        return Term(terms[0], fuzzy=int(mark or 0))


def parse(text: str, mode: str | None = None, near: int = 5):
    """The tree of a query. ``mode``: phrase, all, any or near take the words as they are."""
    if mode in ("phrase", "near"):
        return Parser('"' + text.replace('"', " ") + '"' + (f"~{near}" if mode == "near" else "")).any_of()
    if mode in ("all", "any"):
        words = tuple(Term(t) for t in tokenise(text))
        if not words:
            raise QueryError("nothing to search")
        return words[0] if len(words) == 1 else And(words) if mode == "all" else Or(words)
    p = Parser(text)
    node = p.any_of()
    if p.kind() != "end":
        raise QueryError("a bracket too many", p.parts[p.i].start())
    return node


def matches(node, words: Column) -> Column:
    """Whether a page with these folded words matches."""
    if isinstance(node, Term):
        if node.wild:
            return words.rlike(" " + "".join("[^ ]*" if c == "*" else "[^ ]" if c == "?" else re.escape(c) for c in node.text) + " ")
        if node.fuzzy:
            return F.exists(F.split(words, " "), lambda t: (t != "") & F.levenshtein(t, F.lit(node.text), node.fuzzy).between(0, node.fuzzy))
        if node.ocr:
            return reduce(Column.__or__, [words.contains(f" {s} ") for s in spellings(node.text)])
        return words.contains(f" {node.text} ")
    if isinstance(node, Phrase):
        if not node.slop:
            forms = [" ".join(node.terms)]
            for sign, figures in FRACTIONS.items():
                forms += [f.replace(sign, f" {figures}").strip() for f in forms if sign in f]
            return reduce(Column.__or__, [words.contains(f" {f} ") for f in forms])
        return near(node.terms, node.slop, words)
    if isinstance(node, AtLeast):
        return reduce(Column.__add__, [matches(x, words).cast("int") for x in node.of]) >= node.min
    if isinstance(node, Not):
        return ~matches(node.of, words)
    return reduce(Column.__and__ if isinstance(node, And) else Column.__or__, [matches(x, words) for x in node.of])


def near(terms: tuple[str, ...], slop: int, words: Column) -> Column:
    """All terms on the page, and from each term to the next a place that spends the slop left over at most.

    A place's cost is how far it is from where the phrase would have it after the place before; costs add up.
    Two terms match if some pair of places costs at most ``slop`` (so a swap costs two).
    """
    every = F.filter(F.split(words, " "), lambda t: t != "")
    def places(t: str) -> Column:
        return F.filter(F.transform(every, lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull())

    present = reduce(Column.__and__, [words.contains(f" {t} ") for t in dict.fromkeys(terms)])
    start = F.transform(places(terms[0]), lambda i: F.struct(i.alias("at"), F.lit(0).alias("cost")))
    for t in terms[1:]:
        here = places(t)
        before = start

        def cheapest(j: Column) -> Column:
            return F.struct(j.alias("at"), F.array_min(F.transform(before, lambda x: x["cost"] + F.abs(j - x["at"] - 1))).alias("cost"))

        step = F.transform(here, cheapest)
        start = F.filter(step, lambda x: x["cost"] <= slop)
    return present & (F.size(start) > 0)


def words_of(node) -> set[str]:
    """The plain words a snippet marks; excluded parts are never marked."""
    if isinstance(node, Term):
        return set(spellings(node.text)) if node.ocr else {node.text}
    if isinstance(node, Phrase):
        return set(node.terms)
    if isinstance(node, Not):
        return set()
    return set().union(*(words_of(x) for x in node.of))


def to_column(query: str, words: str | Column = "words", mode: str | None = None, near_by: int = 5) -> Column:
    return matches(parse(query, mode, near_by), F.col(words) if isinstance(words, str) else words)


def language(node, english: set[str], shared: set[str]) -> str | None:
    """jpn for words with Japanese characters only, eng for a query that matches mostly English pages, else None.

    ``english`` and ``shared`` (English and another language's) are lists of folded words. What must all hold is English if a part
    is and the rest is shared or digits; what may hold, if every part is. Wildcards and unknown words can be anything.
    """
    words = words_of(node)
    if words and all(is_japanese(c) for w in words for c in w):
        return "jpn"

    def word(w: str) -> bool | None:
        return True if w in english and w not in shared else None if w in shared or w.isascii() and w.isdigit() else False

    def read(x) -> bool | None:
        """True: English; None: told by the rest; False: cannot be read."""
        if isinstance(x, Not):
            return None
        if isinstance(x, Term):
            return False if x.wild else word(x.text)
        parts = [word(w) for w in x.terms] if isinstance(x, Phrase) else [read(y) for y in x.of]
        if False in parts:
            return False
        if isinstance(x, Phrase | And):
            return True if True in parts else None
        return None if None in parts else True

    return "eng" if read(node) else None
