"""Subject areas of documents by curated terms.

One multi-pattern automaton of all subjects' terms runs over every paragraph; hits are weighted by the rarity of their
term among all documents and normalised by the paragraph's length. A paragraph is about the subject with the greatest
score if that subject has enough of all weighted hits and enough of them per word; a document has every subject that one
of its paragraphs is about. The two thresholds are calibrated on the hand labels.

Defined results: null and empty texts have no subject, nor have texts without any term; repeated rows give repeated
rows; other columns are ignored; an empty table gives an empty result; without labels the default thresholds stand.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: The curated lexicon: lines of subject, weight and term.
TERMS = os.path.join(os.path.dirname(__file__), "subject_terms.tsv")
#: Least share of the weighted hits and least weighted hits per 100 words; used where no labels are given.
DEFAULT_SHARE, DEFAULT_DENSITY = 0.6, 3.0
#: Words a paragraph has at least; shorter ones are titles.
LEAST_WORDS = 10
#: Thresholds that calibration chooses from.
SHARES, DENSITIES = (0.4, 0.5, 0.6, 0.7, 0.8), (0.0, 3.0, 6.0, 10.0, 15.0, 20.0, 30.0)

_HYPHEN = re.compile(r"(?<=[^\W\d_])[-¬‐­]\s*\n\s*(?=[^\W\d_])")
_GONE = re.compile(r"[­​-‏⁠-⁯﻿̀-ͯ]")
_BLANK = re.compile(r"\n[ \t\f\r]*\n\s*|\f")
_CLEAN = re.compile(r"[^\w'-]+")


def paragraphs(text: str | None) -> list[str]:
    """Paragraphs of a text in a form for matching: lower case, joined lines, composed letters."""
    out = []
    for p in _BLANK.split(text or ""):
        p = unicodedata.normalize("NFKC", p)
        p = _GONE.sub("", _HYPHEN.sub("", unicodedata.normalize("NFC", p)))
        p = _CLEAN.sub(" ", p.lower()).strip()
        if p:
            out.append(p)
    return out


@functools.lru_cache(8)
def lexicon(path: str = TERMS) -> tuple[tuple[str, str, float], ...]:
    """(term, subject, weight) of a lexicon file, in order."""
    out = set()
    with open(path, encoding="utf-8") as f:
        for line in f:
            if line.strip() and not line.startswith("#"):
                subject, weight, term = line.rstrip("\n").split("\t")
                out.add((term, subject, float(weight)))
    return tuple(sorted(out))


def _automaton(terms):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (t, *_) in enumerate(terms):
        a.add_word(t, (i, len(t)))
    a.make_automaton()
    return a


def _inside(ch: str) -> bool:
    return ch.isalpha() and not "一" <= ch <= "鿿"


def term_hits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, para, words, hits) with hits = array of (term, n); one row per paragraph. Narrow, one pass."""
    terms = lexicon()
    stems = [any("Ѐ" <= c <= "ӿ" for c in t) for t, *_ in terms]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = _automaton(terms)
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                for no, p in enumerate(paragraphs(t)):
                    found: dict[int, int] = {}
                    for end, (i, n) in a.iter(p):
                        start = end - n
                        if start >= 0 and _inside(p[start]) and _inside(p[start + 1]):
                            continue
                        if end + 1 < len(p) and _inside(p[end + 1]) and _inside(p[end]) and not stems[i] and p[end + 1 : end + 3].strip("s ") != "":
                            continue
                        found[i] = found.get(i, 0) + 1
                    han = sum("一" <= c <= "鿿" for c in p)
                    out.append((k, no, p.count(" ") + 1 + han // 2, [{"term": i, "n": n} for i, n in found.items()]))
            yield pd.DataFrame(out, columns=["k", "para", "words", "hits"])

    kind = df.schema[key].dataType.simpleString()
    own = df.filter(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return own.mapInPandas(rows, f"k {kind}, para int, words int, hits array<struct<term:int,n:int>>").withColumnRenamed("k", key)


def term_weights(hits: DataFrame, key: str = "doc_id") -> list[float]:
    """Weight of each term: its curated weight times its rarity, the log of all documents over those with it. Counts cover every document; only the lexicon reaches the driver."""
    terms = lexicon()
    n = hits.agg(F.approx_count_distinct(key, 0.01)).first()[0] or 1
    df = hits.select(F.explode("hits.term").alias("term")).groupBy("term").count().collect()
    import math

    seen = {r["term"]: r["count"] for r in df}
    return [w * math.log1p(n / (1 + seen.get(i, 0))) for i, (_, _, w) in enumerate(terms)]


def paragraph_scores(hits: DataFrame, weights: list[float], key: str = "doc_id") -> DataFrame:
    """(key, para, subject, share, density, distinct_terms): the leading subject of each paragraph that has any. Narrow."""
    terms = lexicon()
    w = F.array(*map(F.lit, weights))
    names = sorted({s for _, s, _ in terms})
    of = F.array(*[F.lit(names.index(s)) for _, s, _ in terms])
    scores = []

    def of_subject(i):
        return F.filter("hits", lambda h: F.get(of, h["term"]) == i)

    for i, s in enumerate(names):
        own = of_subject(i)
        scores.append(F.struct(
            F.aggregate(own, F.lit(0.0), lambda acc, h: acc + F.get(w, h["term"]) * h["n"]).alias("score"),
            F.aggregate(own, F.lit(0), lambda acc, h: acc + h["n"]).alias("n"), F.lit(s).alias("subject"),
        ))
    one = hits.filter(F.size("hits") > 0).select(key, "para", "words", F.array(*scores).alias("s"))
    one = one.select(key, "para", "words", F.array_max("s").alias("best"), F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x["score"]).alias("all"))
    return one.select(key, "para", "words", "best.subject", "best.score", F.try_divide("best.score", "all").alias("share"), F.try_divide(100 * F.col("best.score"), F.col("words")).alias("density"), F.col("best.n").alias("n"))


def calibrate(scores: DataFrame, labels: DataFrame, key: str = "doc_id") -> tuple[float, float]:
    """The thresholds that agree best (F1) with the hand labels, all of them.

    Each paragraph is turned into the set of grid points it passes, one bit each; only counts a grid point reach the driver.
    """
    grid = [(share, density) for share in SHARES for density in DENSITIES]
    labels = labels.select(key, F.col("subject").alias("label")).dropDuplicates()
    truth = labels.groupBy(key).agg(F.collect_set("label").alias("truth"), F.count("*").alias("n"))
    passed = [F.when((F.col("share") >= share) & (F.col("density") >= density), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, (share, density) in enumerate(grid)]
    # no filter before the groups: pushed below, it would hold the scoring expression once for every mention
    bits = F.when((F.col("n") >= 2) & (F.col("words") >= LEAST_WORDS), functools.reduce(lambda a, b: a.bitwiseOR(b), passed)).otherwise(F.lit(0).cast("bigint"))
    found = scores.select(key, "subject", bits.alias("bits")).groupBy(key, "subject").agg(F.bit_or("bits").alias("bits")).filter("bits <> 0").join(truth.select(key, "truth"), key)
    found = found.groupBy("bits", F.array_contains("truth", F.col("subject")).alias("right")).agg(F.count("*").alias("k"))
    counts = [(r["bits"], r["right"], r["k"]) for r in found.agg(F.collect_list(F.struct("bits", "right", "k")).alias("x")).first()["x"]]
    n = truth.agg(F.sum("n")).first()[0] or 0
    best = (-1.0, DEFAULT_SHARE, DEFAULT_DENSITY)
    for i, (share, density) in enumerate(grid):
        own = [(right, k) for b, right, k in counts if b >> i & 1]
        f1 = 2 * sum(k for right, k in own if right) / max(1, sum(k for _, k in own) + n)
        best = max(best, (f1, share, density))
    return best[1], best[2]


def document_subjects(df: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (key, subject) of the documents.

    Every document with a term at all is to come out with a subject, so one none of whose paragraphs passes gets its leading one.
    """
    hits = cut(term_hits(df, key, text))
    scores = paragraph_scores(hits, term_weights(hits, key), key)
    share, density = calibrate(scores, labels, key) if labels is not None else (DEFAULT_SHARE, DEFAULT_DENSITY)
    passed = (F.col("share") >= share) & (F.col("density") >= density) & (F.col("n") >= 2) & (F.col("words") >= LEAST_WORDS)
    best = scores.groupBy(key).agg(F.collect_set(F.when(passed, F.col("subject"))).alias("s"), F.max_by("subject", F.struct("score", "subject")).alias("lead"))
    return best.select(key, F.explode(F.when(F.size("s") > 0, F.col("s")).otherwise(F.array("lead"))).alias("subject"))
