r"""Quality rules: statistics of whole texts, and a learned decision list over them.

The list is learned on the driver from labelled statistics (a bounded sample: TRAIN_ROWS rows, the first by hash of id):
sequential covering grows a rule, a conjunction of thresholds, by information gain until it covers no good document of
the growing part, prunes it backwards on the other third, and removes what it covers; it ends when a rule is no longer
precise on the pruning part. The rules become one ordered Spark conditional expression.

Edge cases: null and empty texts have no words and fail the base rules (fewer than 20 words); without labels, or with
labels of one kind only, the list is empty and keeps what the base rules keep; null labels and labels of unknown ids are
left out; repeated label rows count once each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightloom.llm.common import WORD, whole

WINDOW = 8
SYMBOLS = "#*$%&|<>"
TRAIN_ROWS = 10_000
#: Shares that rules test, as SQL of the statistics.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclaims_per_word": "n_exclaims / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words": "cast(n_words as double)",
}


def repeated_words(text: str, window: int = WINDOW) -> int:
    """How many words lie in a window of words that the text holds twice or more, the first included. window: 2 ** k."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    step = 1
    while step < window:  # ranks of windows of twice the words, from pairs of ranks
        pair = rank[:-step] * (len(words) + 1) + rank[step:]
        values, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if counts.max() < 2:
            return 0
        step *= 2
    twice = counts[rank] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _repeats(texts: pa.Array) -> pa.Array:
    return pa.array([repeated_words(t or "") for t in texts.to_pylist()], pa.int64())


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base statistics and those that rules test beside them; text_col itself is not changed."""
    text = whole(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    less = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    return docs.withColumns(
        {
            "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.arrow_udf(_repeats, "long")(text),
            "n_lines": F.size(lines).cast("long"),
            "n_upper": less(r"\p{Lu}+"),
            "n_digits": less(r"[0-9]+"),
            "n_exclaims": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    limit: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.limit if self.above else x[self.feature] <= self.limit

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.limit if self.above else value <= self.limit


Rule = tuple[Test, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    keep = np.ones(len(next(iter(x.values()))), bool)
    for t in rule:
        keep &= t.covers(x)
    return keep


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Test | None]:
    """The test with the largest information gain among those rows that the rule covers so far."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    now, best = math.log2(p0 / (p0 + n0)), (0.0, None)
    for name, values in x.items():
        v, y = values[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, p = v[order], np.cumsum(y[order])
        n = np.arange(1, len(v) + 1) - p
        cut = np.flatnonzero(v[:-1] < v[1:])
        for above in (False, True):
            pp, nn = (p0 - p[cut], n0 - n[cut]) if above else (p[cut], n[cut])
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / np.maximum(pp + nn, 1)) - now), -1.0)
            if len(cut) and (k := int(np.argmax(gain))) is not None and gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), Test(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, *, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Ordered rules that tell bad rows. part: true for rows to grow rules on, false for rows to prune them on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while (bad & left & part).sum() >= least:
        rule: Rule = ()
        while True:
            inside = left & part & _covered(rule, x)
            if not (bad & inside).any() or not (~bad & inside).any():
                break
            _, test = _best_test(x, bad, inside)
            if test is None:
                break
            rule += (test,)
        if not rule:
            break

        def worth(r: Rule) -> float:
            inside = left & ~part & _covered(r, x)
            p, n = int((bad & inside).sum()), int((~bad & inside).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        grown, pruned = left & part & _covered(rule, x), left & ~part & _covered(rule, x)
        right = lambda rows: (bad & rows).sum() / max(1, rows.sum())
        if (bad & grown).sum() < least or right(grown) < precision or pruned.sum() and right(pruned) < precision:
            break
        rules.append(rule)
        left &= ~_covered(rule, x)
    return rules


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS) -> list[Rule]:
    """The decision list for stats (statistics() of documents), learned from at most `rows` rows of labels (0: bad)."""
    picked = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(rows)
    # At most `rows` ids and labels: small whatever the size of the data.
    known = stats.join(F.broadcast(picked), "doc_id").select("doc_id", "_y", *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()], base_failed().alias("failed"))
    found = known.orderBy("doc_id", "_y", *FEATURES).toPandas()
    found = found[~found["failed"].astype(bool)]
    if found.empty:
        return []
    part = np.array([zlib.crc32(str(i).encode()) % 3 != 0 for i in found["doc_id"]])
    return learn({f: found[f].to_numpy(float) for f in FEATURES}, found["_y"].to_numpy() == 0, part)


def verdict(rules: list[Rule]) -> Column:
    """false for what the first matching rule rejects, else true: one ordered conditional expression."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test &= t.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, the statistics, base_failed and kept."""
    stats = statistics(docs.select("doc_id", "text"))
    # Only labelled documents are read for training.
    picked = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(TRAIN_ROWS)
    some = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")
    rules = train(statistics(some), picked)
    out = stats.withColumn("base_failed", base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
