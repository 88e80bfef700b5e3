"""Page words, garbage, language by function words, damage against a word model, and a character model for quality."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Frequent function words by language: short lists of our own.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now people my made over did down only way find use may water long little very after words called just where most know".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la ou avec son aux d cette ces sa ses mais comme on tout nous sa fait leur bien deux elle si leurs y dont meme sans peu ainsi".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem uber einen so zum war haben nur oder aber vor zur bis mehr durch man sein".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como mas o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos tambien fue habia era muy anos hasta desde".split(),
}
MIN_WORDS, MIN_SHARE, MIN_DISTINCT, LEAD = 20, 0.10, 10, 2.0


def lists(spark) -> DataFrame:
    rows = [(code, w, i) for code, ws in FUNCTION_WORDS.items() for i, w in enumerate(dict.fromkeys(ws))]
    return spark.createDataFrame(rows, "language string, word string, rank int")  # a fixed table of a few hundred rows


def detect(pages: DataFrame, tokens: str, id_col: str = "doc_id") -> DataFrame:
    """Language of each page by its share of function words: id, words, language (und: no clear lead)."""
    ls = lists(pages.sparkSession)
    shared = ls.groupBy("word").agg(F.count("*").alias("n"))
    ls = ls.join(shared, "word")
    words = pages.select(id_col, F.size(tokens).alias("words"), F.explode_outer(tokens).alias("word"))
    counted = words.groupBy(id_col, "words", "word").agg(F.count("word").alias("c"))
    hits = counted.join(F.broadcast(ls), "word", "left").groupBy(id_col, "words", "language").agg(F.sum("c").alias("c"), F.count("*").alias("distinct"), F.sum(F.when(F.col("n") == 1, F.col("c")).otherwise(0)).alias("own"))
    w = W.partitionBy(id_col).orderBy(F.desc("c"), "language")
    top = hits.where("language is not null").withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("own").over(w)).where("n = 1")
    sized = pages.select(id_col, F.size(tokens).alias("words"))
    j = sized.join(top.select(id_col, "language", "c", "distinct", "own", "next"), id_col, "left")
    clear = (F.col("words") >= MIN_WORDS) & (F.col("c") >= MIN_SHARE * F.col("words")) & (F.col("distinct") >= MIN_DISTINCT) & (F.col("own") >= LEAD * F.coalesce("next", F.lit(0)))
    return j.select(id_col, "words", F.when(clear, F.col("language")).otherwise("und").alias("language"))


def is_garbage(token: str) -> bool:
    """Tokens no page prints: overlong, mostly signs, triple letters, no or only vowels, mixed case."""
    n = len(token)
    if n > 40 or n >= 2 and sum(not c.isalnum() for c in token) * 2 > n:
        return True
    low = token.lower()
    if re.search(r"(\w)\1\1", low) and not re.fullmatch(r"[mdclxvi]+", low):
        return True
    if n >= 4 and low.isascii() and low.isalpha():
        vowels = sum(c in "aeiouy" for c in low)
        if vowels in (0, n):
            return True
        if token[1:] != token[1:].lower() and token != token.upper():
            return True
    return False


def near_misses(head: list[str], real: set[str]) -> dict[str, str]:
    """Strings one edit away from a frequent word that are no words themselves, with the word; simplest edits first."""
    out: dict[str, str] = {}
    letters = "abcdefghijklmnopqrstuvwxyz"
    for edit in ("substitute", "delete", "insert", "split"):
        for w in head:
            if edit == "substitute":
                made = [w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters if c != w[i]]
            elif edit == "delete":
                made = [w[:i] + w[i + 1 :] for i in range(len(w))]
            elif edit == "insert":
                made = [w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters]
            else:
                made = [w[:i] for i in range(2, len(w))] + [w[i:] for i in range(1, len(w) - 1)]
            for m in made:
                if len(m) > 1 and m not in real:
                    out.setdefault(m, w)
    return out


def damage(pages: DataFrame, tokens: str, language: str, id_col: str = "doc_id", head: int = 20) -> DataFrame:
    """Per page the occurrences of frequent words (head), of their near misses (near) and near / (near + head)."""
    real = {w for ws in FUNCTION_WORDS.values() for w in ws}
    top = FUNCTION_WORDS[language][:head]
    rows = [(w, "head") for w in top] + [(m, "near") for m in near_misses(top, real)]
    model = pages.sparkSession.createDataFrame(rows, "word string, kind string")  # a few thousand rows at most
    hits = pages.select(id_col, F.explode(tokens).alias("word")).join(F.broadcast(model), "word").groupBy(id_col).agg(F.count_if(F.col("kind") == "head").alias("head"), F.count_if(F.col("kind") == "near").alias("near"))
    zero = F.lit(0).cast("long")
    j = pages.select(id_col).join(hits, id_col, "left").select(id_col, F.coalesce("head", zero).alias("head"), F.coalesce("near", zero).alias("near"))
    return j.withColumn("damage", F.when(F.col("head") + F.col("near") > 0, F.col("near") / (F.col("head") + F.col("near"))))


class CharModel:
    """Interpolated Witten-Bell model of character runs; bits per character of a reading."""

    def __init__(self, text: str, order: int = 5):
        self.order = order
        self.runs: list[Counter] = [Counter() for _ in range(order + 1)]
        self.types: list[Counter] = [Counter() for _ in range(order + 1)]
        self.all: list[Counter] = [Counter() for _ in range(order + 1)]
        for n in range(1, order + 1):
            for i in range(len(text) - n + 1):
                g = text[i : i + n]
                if not self.runs[n][g]:
                    self.types[n][g[:-1]] += 1
                self.runs[n][g] += 1
                self.all[n][g[:-1]] += 1
        self.letters = max(len(set(text)), 1)

    def p(self, before: str, c: str) -> float:
        out = 1 / (self.letters + 1)
        for n in range(1, self.order + 1):
            ctx = before[len(before) - n + 1 :] if n > 1 else ""
            if len(ctx) != n - 1 or not self.all[n][ctx]:
                break
            t = self.types[n][ctx]
            out = (self.runs[n][ctx + c] + t * out) / (self.all[n][ctx] + t)
        return out

    def bits(self, text: str) -> float | None:
        if not text:
            return None
        return -sum(math.log2(self.p(text[max(0, i - self.order + 1) : i], c)) for i, c in enumerate(text)) / len(text)


def quality(bits: Column, unknown: Column) -> Column:
    """Both signals on one scale."""
    return bits / 1.185 + unknown / 0.117


def preferred(a_known3: Column, a: Column, b_known3: Column, b: Column) -> Column:
    """The better of two readings; one that lost a fifth of the other's known words cannot win."""
    return F.when(a_known3 < 0.8 * b_known3, "b").when(b_known3 < 0.8 * a_known3, "a").when(a < b, "a").when(b < a, "b")
