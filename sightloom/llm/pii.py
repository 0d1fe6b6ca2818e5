r"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The base finds emails, IP addresses, payment cards and phone numbers by pattern. The field adds secrets (tokens,
passwords, access keys): it labels the tokens around everything that could be one (a token of MIN_VALUE or more letters
and digits that mixes the two, or what stands right after one of KEYS and = or :), with O, B and I, and Viterbi decoding finds
the best labels for many windows at once in numpy. Its features are word shapes, lengths, classes of characters and key
words, of a token and its neighbours; it is trained by gradient ascent on a small labelled table, labelled_table() unless
another is given. A base span that overlaps one of the field's makes the latter go.

Edge cases: null and empty texts have no spans; texts of any length are read whole, in time that follows their length;
leading zeros of an ip's parts do not count; repeated rows and repeated or null ids are reported each; other columns are
ignored; an empty table gives an empty result. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base: an email's characters before its @, and what follows that. A match takes whole runs of
#: digits and of such characters, so that trying from the first of a run is enough, and long runs cost no more than once.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "secret")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base patterns' matches that pass their tests."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        first = done + len(text[done:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if first < at else None
        if found:
            out.append((first, 0, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            # Longer runs fail without counting.
            if m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# --- the field

TOKEN = re.compile(r"[A-Za-z0-9_+/-]+|[^\sA-Za-z0-9_+/-]")
MIN_VALUE = 8
#: Words that stand before secrets.
KEYS = frozenset("password passwd pwd pass token secret apikey api_key api-key key access_key secret_key auth bearer credential aws_access_key_id".split())
_RUN = re.compile(rf"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{{{MIN_VALUE},}}+")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Cells (windows by tokens of the longest) that are decoded at once.
CELLS = 200_000
_KEY_VALUE = re.compile(r"(?:api[_-]?key|" + "|".join(map(re.escape, sorted(KEYS, key=lambda k: (-len(k), k)))) + r")\s?[=:]\s?[\"']?([^\s\"'<>,;]{4,})", re.I)
SIDE, FEATURES, LABELS = 4, 1 << 12, 3


def shape(token: str) -> str:
    """Runs of capitals, small letters and digits as A, a and 9; long shapes end in +."""
    s = re.sub(r"[A-Z]+", "A", token)
    s = re.sub(r"[a-z]+", "a", s)
    s = re.sub(r"[0-9]+", "9", s)
    return s if len(s) <= 6 else s[:6] + "+"


def traits(token: str) -> list[str]:
    """A token's own features; neighbours carry them with their distance."""
    low, n = token.lower(), len(token)
    digits = sum(c.isdigit() for c in token)
    mixed = 0 < digits < sum(c.isalnum() for c in token)
    out = [f"s={shape(token)}", f"n={min(n // 4, 10)}", f"k={low in KEYS}"]
    if n == 1 and not token.isalnum():
        out.append(f"p={token}")
    if mixed:
        out += ["mixed", f"hex={bool(re.fullmatch('[0-9a-f]+', token) or re.fullmatch('[0-9A-F]+', token))}", f"turns={min(8, sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False)))}", f"upper={token == token.upper()}"]
    return out


def feature_ids(tokens: list[str]) -> list[np.ndarray]:
    own = [traits(t) for t in tokens]
    rows = []
    for i in range(len(tokens)):
        names = [f"{d}:{x}" for d in range(-3, 2) if 0 <= i + d < len(tokens) for x in own[i + d]]
        rows.append(np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "big") % FEATURES for x in names]))
    return rows


@dataclass
class Crf:
    emit: np.ndarray
    move: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.emit[r].sum(0) for r in rows])


#: I never follows O, and no sequence starts with it.
_START = np.array([0.0, 0.0, -1e9])
_BAN = np.zeros((LABELS, LABELS))
_BAN[0, 2] = -1e9


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    """The logarithm of the sum of exponentials."""
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[int]]], steps: int = 200, rate: float = 0.5, l2: float = 1e-4) -> Crf:
    """Maximum likelihood by gradient ascent over the whole table (AdaGrad), with forward and backward sums.

    All sequences go side by side, padded; a sequence's sums do not change where it is over.
    """
    crf = Crf(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)))
    rows = [feature_ids(t) for t, _ in table]
    n, time = np.array([len(r) for r in rows]), max(len(r) for r in rows)
    live = np.arange(time)[None, :] < n[:, None]
    tokens = [r for seq in rows for r in seq]
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(r) for r in tokens])
    gold = np.zeros((len(rows), time), int)
    for k, (_, y) in enumerate(table):
        gold[k, : len(y)] = y
    real = np.eye(LABELS)[gold] * live[:, :, None]
    both = live[:, 1:, None, None] * (np.eye(LABELS)[gold[:, :-1]][:, :, :, None] * np.eye(LABELS)[gold[:, 1:]][:, :, None, :])
    seen_e, seen_m = np.full_like(crf.emit, 1e-8), np.full_like(crf.move, 1e-8)
    for _ in range(steps):
        s = np.zeros((len(rows), time, LABELS))
        s[live] = np.stack([np.bincount(owner, crf.emit[flat, y], len(tokens)) for y in range(LABELS)], 1)
        move = crf.move + _BAN
        ahead, back = np.zeros_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0] + _START
        for i in range(1, time):
            step = _lse(ahead[:, i - 1, :, None] + move, 1) + s[:, i]
            ahead[:, i] = np.where(live[:, i, None], step, ahead[:, i - 1])
        for i in range(time - 2, -1, -1):
            back[:, i] = np.where(live[:, i + 1, None], _lse(move[None] + (s[:, i + 1] + back[:, i + 1])[:, None, :], 2), 0)
        z = _lse(ahead[:, -1], 1)[:, None, None]
        p = np.exp(ahead + back - z) * live[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + move + (s[:, 1:] + back[:, 1:])[:, :, None, :] - z[..., None]) * live[:, 1:, None, None]
        d = (real - p)[live]
        ge = np.stack([np.bincount(flat, d[owner, y], FEATURES) for y in range(LABELS)], 1) / len(rows) - l2 * crf.emit
        gm = (both - pair).sum((0, 1)) / len(rows) - l2 * crf.move
        seen_e += ge**2
        seen_m += gm**2
        crf.emit += rate * ge / np.sqrt(seen_e)
        crf.move += rate * gm / np.sqrt(seen_m)
    return crf


def viterbi(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of a batch of sequences: scores (batch, time, label), padded; labels after a sequence's end are O."""
    batch, time, _ = scores.shape
    best = scores[:, 0] + _START
    back = np.zeros((batch, time, LABELS), np.int8)
    move = move + _BAN
    for t in range(1, time):
        through = best[:, :, None] + move[None]
        back[:, t] = through.argmax(1)
        now = through.max(1) + scores[:, t]
        # A sequence that is over keeps its score and its last label.
        over = t >= lengths
        back[over, t] = np.arange(LABELS)
        best = np.where(over[:, None], best, now)
    out = np.zeros((batch, time), np.int8)
    label = best.argmax(1)
    for t in range(time - 1, -1, -1):
        out[:, t] = label
        label = back[np.arange(batch), t, label]
    out[np.arange(time)[None, :] >= lengths[:, None]] = 0
    return out


def labelled_table(seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """A few hundred token sequences with labels: secrets in their usual surroundings, and look-alikes that are none."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, hexa, up, dig = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, r.randint(2, 9))
    words = lambda n: " ".join(word() for _ in range(r.randint(1, n)))
    must = lambda s: s[:-2] + r.choice(dig) + r.choice(low)
    value = lambda: r.choice([must(pick(hexa, r.choice([16, 18, 20, 24, 32, 40, 64]))), must(pick(low + up + dig, r.randint(12, 40))), "AKIA" + pick(up + dig, 16), "ghp_" + must(pick(low + up + dig, 36)), "sk-" + must(pick(low + up + dig, 32))])
    key = lambda: r.choice(sorted(KEYS))
    out: list[tuple[list[str], list[int]]] = []

    def add(before: str, secret: str, after: str) -> None:
        parts = [(TOKEN.findall(before), 0), (TOKEN.findall(secret), 1), (TOKEN.findall(after), 0)]
        tokens = [t for p, _ in parts for t in p]
        labels = [(1 if k == 0 else 2) if s else 0 for p, s in parts for k in range(len(p))]
        if tokens:
            out.append((tokens, labels))

    for _ in range(160):
        q = r.choice(["", "", '"', "'"])
        eq = r.choice(["=", " = ", ": ", ":"])
        add(f"{words(4)} {key()}{eq}{q}", value(), f"{q} {words(4)}")
    for _ in range(40):
        add(f"{words(4)} {r.choice(['password', 'pwd', 'passwd'])}{r.choice(['=', ': '])}", pick(low, r.randint(5, 9)) + pick(dig, r.randint(1, 4)), f" {words(3)}")
    for _ in range(60):
        add(words(5) + " ", r.choice(["AKIA" + pick(up + dig, 16), "ghp_" + must(pick(low + up + dig, 36)), must(pick(hexa, r.choice([32, 40])))]), " " + words(5))
    for _ in range(240):
        look = r.choice([f"{word()}{r.randint(1, 99)}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{word()}-{r.randint(1, 2000)}-{word()}", f"v{r.randint(1, 9)}_{r.randint(0, 9)}_{word()}", f"{word()}_{word()}{r.randint(1, 9)}", pick(dig, r.randint(8, 20)), f"{word()}{r.randint(100, 999)}{word()}", f"{r.randint(1, 9)}x{r.randint(1, 9)}{word()}", f"+1 ({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}", f"{word()}.{r.randint(1, 99)}@{word()}{r.randint(0, 9)}.example.com", f"{r.choice(sorted(KEYS))} {word()}", word()])
        add(f"{words(5)} {look} {words(5)}", "", "")
    for _ in range(60):  # values with other characters
        add(f"{words(4)} {key()}{r.choice(['=', ' = ', ': ', ':'])}", pick(low, r.randint(2, 7)) + r.choice("!#$%&*@?^~") + pick(low, r.randint(2, 7)) + pick(dig, r.randint(0, 3)), f" {words(3)}")
    return out


def default_crf() -> Crf:
    return train(labelled_table())


def key_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of what stands after a key word and = or :, to the next white space, quote or , ; < >, without final punctuation."""
    if "=" not in text and ":" not in text:
        return []
    found = [(m.start(1), m.start(1) + len(m[1].rstrip(".:!?()[]{}"))) for m in _KEY_VALUE.finditer(text)]
    return [(s, e) for s, e in found if e - s >= 4]


def windows(text: str) -> list[list[tuple[str, int, int]]]:
    """Token windows (token, start, end) around everything that could be a secret; near ones are one window."""
    spots = [(m.start(), m.end()) for m in _RUN.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]
    spots += key_values(text)
    out: list[list[tuple[str, int, int]]] = []
    done = 0
    for s, e in sorted(spots):
        if s < done:
            continue
        left = text[max(done, s - 80) : s]
        before = [(m[0], s - len(left) + m.start(), s - len(left) + m.end()) for m in TOKEN.finditer(left)][-SIDE:]
        after = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text, e, min(len(text), e + 80))][:SIDE]
        out.append([*before, *((m[0], m.start(), m.end()) for m in TOKEN.finditer(text, s, e)), *after])
        done = e
    return out


def secret_spans(texts: list[str], crf: Crf) -> list[list[tuple[int, int]]]:
    """(start, end) of the secrets in each text; windows of all texts are decoded together."""
    found = [(k, w) for k, t in enumerate(texts) if any(c in t for c in "0123456789=:") for w in windows(t)]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    found.sort(key=lambda x: (len(x[1]), x[0], x[1][0][1]))
    first = 0
    while first < len(found):
        # Windows of similar length go together, as many as CELLS allow, or one.
        last = first + 1
        while last < len(found) and (last + 1 - first) * len(found[last][1]) <= CELLS:
            last += 1
        part, first = found[first:last], last
        lengths = np.array([len(w) for _, w in part])
        scores = np.zeros((len(part), lengths.max(), LABELS))
        for i, (_, w) in enumerate(part):
            scores[i, : len(w)] = crf.scores(feature_ids([t for t, _, _ in w]))
        for (k, w), labels in zip(part, viterbi(scores, lengths, crf.move), strict=True):
            span = None
            for (_, s, e), y in zip(w, labels, strict=False):
                if y == 2 and span:
                    span = (span[0], e)
                else:
                    out[k] += [span] if span else []
                    span = (s, e) if y == 1 else None
            out[k] += [span] if span else []
    return [_widened(t, sorted(x)) for t, x in zip(texts, out, strict=True)]


def _widened(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, each with the whole of the key's value that it is in: a value of several tokens is one secret.

    Elsewhere, a span without a letter or digit is punctuation.
    """
    values = key_values(text) if spans else []
    ends = [b for _, b in values]
    out = set()
    for s, e in spans:
        k = bisect_right(ends, s)
        own = (min(s, values[k][0]), max(e, values[k][1])) if k < len(values) and values[k][0] < e else None
        if own or any(c.isalnum() for c in text[s:e]):
            out.add(own or (s, e))
    return sorted(out)


def all_spans(texts: list[str], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and base with the field's spans, of each text."""
    out = []
    for text, more in zip(texts, secret_spans(texts, crf), strict=True):
        base = base_spans(text)
        # Starts by place, and the furthest end of all spans up to each: a span overlaps one that starts before its end.
        starts, tops = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
        free = [(s, 4, e) for s, e in more if not (k := bisect_left(starts, e)) or tops[k - 1] <= s]
        out.append((base, sorted([*base, *free])))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base:string,spans:string,n_secret:bigint>"


def find(docs: DataFrame, crf: Crf | None = None, text_col: str = "text") -> DataFrame:
    """docs with a struct column found: counts, and base and all spans as text. The model is small and goes by value."""
    model = crf or default_crf()

    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for base, every in all_spans([t or "" for t in texts.to_pylist()], model):
            kinds = [k for _, k, _ in base]
            rows.append({**{f"n_{KINDS[k]}": kinds.count(k) for k in range(4)}, "base": _joined(base), "spans": _joined(every), "n_secret": len(every) - len(base)})
        kind = pa.struct([*[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64())])
        return pa.array(rows, kind)

    return docs.withColumn("found", F.arrow_udf(of, FOUND)(F.col(text_col)))


def reported(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """The contract's columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; and n_secret."""
    rows = find(docs.select("doc_id", "text"), crf)
    return rows.select("doc_id", *[F.col(f"found.n_{k}").alias(f"n_{k}") for k in KINDS[:4]], F.sha2(F.col("found.base").cast("binary"), 256).alias("base_sha256"), F.col("found.spans").alias("spans"), F.col("found.n_secret").alias("n_secret"))
