r"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the windows around what they find.

The lexicon is learned. Words of labelled training documents are counted by DataFrame aggregation; prefixes of words
that toxic documents hold far more often than others become terms: whole words, or stems where many endings occur. The
terms form a trie. A word's Levenshtein automaton (distance 1, simulated bit-parallel over the word's positions) runs
along the trie's branches at once, so that misspelled terms are found without listing them. Around every finding a
window of CONTEXT words is looked at: quotation marks on both sides, words of reporting, both or neither are four kinds of
windows. A logistic model over the counts of findings (per term, exact and misspelled; and per kind of window, exact and
misspelled) gives the score, so that how far a window tells quotation from abuse is learned.

Labels are learned from at most TRAIN_ROWS labelled rows, the first by hash of id, and only from those whose
crc32(doc_id as text) mod 5 is not 0; neither labels nor other columns than the text are inputs of a score.

Edge cases: null and empty texts hold no findings and get the model's base score; texts are read whole; null labels and
ids are left out of training; without labels of both kinds every score is the share of label 1 (0 without any);
repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightloom.llm.common import slices, take_over, whole

TRAIN_ROWS = 20_000
LEAST, MOST = 4, 10
CONTEXT = 6
#: Kinds of windows.
WINDOWS = 4
CLEAN_WORDS = 1_000_000
LETTERS = re.compile(r"[^\W_]+")
QUOTES = frozenset('"“”„«»‘’‹›')
#: Words of reporting: beside them a term is more likely quoted than used.
REPORTING = frozenset("said says wrote quote quoted quotes called calling word term slur dit écrit zitat sagte schrieb dijo escribió".split())


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


class Trie:
    """Terms of a lexicon. A node is [children, term or None]; terms that end with * are stems."""

    def __init__(self, terms: list[str]) -> None:
        self.root: list = [{}, None]
        for k, term in enumerate(terms):
            node = self.root
            for c in term.rstrip("*"):
                node = node[0].setdefault(c, [{}, None])
            node[1] = (k, term.endswith("*"), len(term.rstrip("*")) >= 5)
        # One edit leaves one half of a term as it is: the first at a word's start, or the second. Other words match none.
        plain = sorted({t.rstrip("*") for t in terms})
        starts = [t[: len(t) // 2] if len(t) >= 5 else t for t in plain]
        halves = ["^(?:" + "|".join(map(re.escape, starts)) + ")", *(re.escape(t[len(t) // 2 :]) for t in plain if len(t) >= 5)]
        self.gate = re.compile("|".join(halves)) if terms else re.compile(r"(?!)")

    def matches(self, word: str) -> dict[int, int]:
        """term: distance (0 or 1) of the terms that a word is, or begins with where the term is a stem."""
        if not self.gate.search(word):
            return {}
        place: dict[str, int] = {}
        for i, c in enumerate(word):
            place[c] = place.get(c, 0) | 1 << i + 1
        last = 1 << len(word)
        out: dict[int, int] = {}
        stack = [(self.root, 1, 3)]
        while stack:
            (children, term), none, one = stack.pop()
            if term:
                k, stem, fuzzy = term
                if none if stem else none & last:
                    out[k] = 0
                elif fuzzy and (one if stem else one & last) and k not in out:
                    out[k] = 1
            for c, node in children.items():
                at = place.get(c, 0)
                a = none << 1 & at
                # One edit: the letter after an edit before; or this letter is another, left out, or added here.
                b = (one << 1 & at | none << 1 | none | a << 1) & (2 * last - 1)
                if b:
                    stack.append((node, a, b))
        return out


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    trie: Trie | None = None
    clean: set = field(default_factory=set)
    found: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "weights": self.weights, "bias": self.bias, "trie": None, "clean": set(), "found": {}}

    def look(self, word: str) -> list[tuple[int, int]]:
        """(term, distance) of the findings in a word between white space."""
        if self.trie is None:
            self.trie = Trie(self.terms)
        low = word.lower()
        parts = LETTERS.findall(low)
        found = [m for part in parts if len(part) >= LEAST - 1 for m in self.trie.matches(part).items()]
        if len(parts) > 1:
            # Punctuation within a word may stand for a letter of a term: the whole is looked at for terms that no part has.
            known = {k for k, _ in found}
            inner = low[low.index(parts[0]) : low.rindex(parts[-1]) + len(parts[-1])]
            found += [m for m in self.trie.matches(inner).items() if m[0] not in known]
        return found

    def findings(self, text: str) -> list[tuple[int, int, int]]:
        """(term, distance, kind of window: 1 marks, 2 reporting, 3 both, 0 neither) of every finding of a text."""
        words = text.split()
        for w in set(words).difference(self.clean).difference(self.found):
            if m := self.look(w):
                self.found[w] = m
            else:
                if len(self.clean) >= CLEAN_WORDS:
                    self.clean.clear()
                self.clean.add(w)
        if self.found.keys().isdisjoint(words):
            return []
        out = []
        for i, w in enumerate(words):
            if m := self.found.get(w):
                before, after = words[max(0, i - CONTEXT) : i + 1], words[i : i + CONTEXT + 1]
                marks = any(QUOTES.intersection(x) for x in before) and any(QUOTES.intersection(x) for x in after)
                told = any(x.lower().strip(".,:;!?") in REPORTING for x in (*before[:-1], *after[1:]))
                out += [(k, d, marks + 2 * told) for k, d in m]
        if len(self.found) > CLEAN_WORDS:
            self.found.clear()
        return out

    def features(self, text: str) -> dict[int, float]:
        """Counts of a text, dampened: per term, and per kind of window, exact and misspelled."""
        out: dict[int, float] = {}
        n = 2 * len(self.terms)
        for k, d, window in self.findings(text):
            for f in (2 * k + d, n + 2 * window + d):
                out[f] = out.get(f, 0.0) + 1.0
        return {f: math.log1p(v) for f, v in out.items()}

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[f] * v for f, v in self.features(text).items()) if self.terms else self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def count_prefixes(rows: DataFrame) -> DataFrame:
    """prefix, length of word counts: in how many toxic and other texts words with a prefix stand. rows: text, toxic."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(whole("text")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    by_word = rows.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    cut = by_word.filter(F.length("word") >= LEAST).select("*", F.explode(F.sequence(F.lit(LEAST), F.least(F.lit(MOST), F.length("word")))).alias("n"))
    prefix = F.substring(F.col("word"), F.lit(1), F.col("n"))
    return cut.groupBy(prefix.alias("prefix")).agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum(F.when(F.length("word") == F.col("n"), F.col("t")).otherwise(0)).alias("whole"))


def lexicon(counts: list[tuple[str, int, int, int]], toxic: int, other: int) -> list[str]:
    """Terms from (prefix, toxic texts, other texts, toxic texts that hold it as a whole word)."""
    odds = lambda t, c: math.log((t + 0.5) / (toxic + 1) / ((c + 0.5) / (other + 1)))
    least = max(3, 0.005 * toxic)
    by = {p: (t, c, w) for p, t, c, w in counts if t >= least and odds(t, c) >= 3}
    out: dict[str, tuple[int, bool]] = {}
    covered: set[str] = set()
    longer: dict[str, list[str]] = {}
    for q in by:
        longer.setdefault(q[:-1], []).append(q)
    for p in sorted(by, key=lambda p: (len(p), p)):
        if any(p[:k] in covered for k in range(LEAST, len(p))):
            continue
        covered.add(p)
        # As long as nearly all of its texts stay.
        t = by[p][0]
        while len(p) < MOST and (more := max(longer.get(p, []), key=lambda q: by[q][0], default=None)) and by[more][0] >= 0.95 * t:
            p = more
        whole_word = by[p][2] >= 0.95 * by[p][0] and len(p) < MOST
        out[p] = (t, whole_word)
    return sorted(p if out[p][1] else f"{p}*" for p in out)


def _fit(at: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, steps: int = 400, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient descent with momentum over sparse counts (row, column, value); deterministic."""
    w, b = np.zeros(size), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, value * w[col], len(y)) + b, -30, 30)))
        vw = 0.9 * vw - 1.0 * (np.bincount(col, value * (p - y)[at], size) / len(y) + l2 * w)
        vb = 0.9 * vb - 1.0 * float((p - y).mean())
        w, b = w + vw, b + vb
    return w, b


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights, learned from at most `rows` labelled rows that are not held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # At most `rows` ids: small whatever the size of the data.
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    some = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").persist()
    try:
        n = some.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
        toxic, other = n["t"] or 0, n["n"] - (n["t"] or 0)
        if not toxic or not other:
            return Model([], bias=math.log((toxic + 1e-9) / (other + 1e-6)))
        least = max(3, 0.005 * toxic)
        ratio = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (other + 1))
        counts = count_prefixes(some).filter((F.col("t") >= least) & (ratio >= math.exp(3))).orderBy(F.desc("t"), "prefix")
        model = Model(lexicon([tuple(r) for r in counts.select("prefix", "t", "c", "whole").collect()], toxic, other))
        seen = some.select("doc_id", "toxic", _features(model)(F.col("text")).alias("f")).orderBy("doc_id", "toxic").collect()
    finally:
        some.unpersist()
    size = 2 * len(model.terms) + 2 * WINDOWS
    y = np.array([r["toxic"] for r in seen], float)
    cells = [(i, f, v) for i, r in enumerate(seen) for f, v in (r["f"] or {}).items()]
    at, col, value = (np.array([c[k] for c in cells], t) for k, t in enumerate((np.int64, np.int64, float)))
    model.weights, model.bias = _fit(at, col, value, y, size)
    return model


def _nothing() -> None:
    """A model's words go with its task."""


def _features(model: Model):
    def of(texts: pa.Array) -> pa.Array:
        take_over("toxicity", _nothing)
        return pa.array([list(model.features(t or "").items()) for some in slices(texts) for t in some.to_pylist()], pa.map_(pa.int32(), pa.float64()))

    return F.arrow_udf(of, "map<int,double>")


def score(model: Model, text: Column) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        take_over("toxicity", _nothing)
        return pa.array([model.score(t or "") for some in slices(texts) for t in some.to_pylist()], pa.float64())

    return F.arrow_udf(of, "double")(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    rows = docs.select("doc_id", held_out().alias("held_out"), score(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs without those scored 0.5 or more. labelled: documents that labels are about, where docs does not hold them."""
    return docs.filter(score(train(docs if labelled is None else labelled, labels), F.col("text")) < 0.5)
