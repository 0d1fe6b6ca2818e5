r"""Byte-pair encoding and decoding with a given tokenizer file (tokenizers library, JSON; a BPE with word ends).

A text is cut at white space and into pre-tokens; each pre-token's bytes are symbols of a doubly linked list, and a
priority queue holds the possible merges by rank, then place. A popped merge whose symbols have changed meanwhile is
stale and skipped. Ids of a text's words are cached by word in each Python worker, in a table of bounded size.
Decoding puts vocabulary strings together, as a tokenizer without decoder does: with one space between.

The file is read on the driver and broadcast; its size (a vocabulary) does not grow with the data.

Edge cases: null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole; special
tokens in a text are found first and become their own ids; null ids decode to the empty text.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightloom.llm.common import sha256_hex, slices, take_over

#: Characters with the property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: White space for str.split() alone.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Of each of two generations.
CACHED_WORDS, CACHED_TOKENS, CACHED_CHARS = 250_000, 350_000, 48
#: Letters in a row are one token of this pattern, and so is a full stop or comma by itself.
LETTERS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """Encodes words with the vocabulary, merges, pattern and special tokens of a tokenizer file's JSON."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        v = self.vocab
        #: By pair of ids: the merge's rank. By rank: the pair and what it becomes.
        self.ranks: dict[int, int] = {}
        self.left, self.right, self.new = [], [], []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[v[a] << 32 | v[b]] = rank
            self.left.append(v[a])
            self.right.append(v[b])
            self.new.append(v[a + b])
        chars = byte_chars()
        self.inner, self.last = [v[c] for c in chars], [v[c + end] for c in chars]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in {**v, **self.special}.items()}
        self.table = pa.array([self.strings.get(i) for i in range(max(self.strings) + 1)], pa.large_string())
        found = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern, self.by_letters = regex.compile(found[0]), found[0] == LETTERS_PATTERN
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.spaces = regex.compile(f"[^{SPACE}]+")
        self.words = _Words(self.word, CACHED_WORDS)
        self.tokens = _Words(self.token, CACHED_TOKENS)

    def merge(self, ids: list[int]) -> list[int]:
        """The symbols left when merges are applied by rank, leftmost first."""
        n, rank = len(ids), self.ranks.get
        # An entry is rank << 32 | place; what it merges is known by its rank.
        found = [rank(a << 32 | b) for a, b in zip(ids, ids[1:], strict=False)]
        queue = [r << 32 | i for i, r in enumerate(found) if r is not None]
        if not queue:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        left, right, new, pop, push = self.left, self.right, self.new, heapq.heappop, heapq.heappush
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            r = entry >> 32
            j = after[i]
            if j < 0 or ids[i] != left[r] or ids[j] != right[r]:
                continue
            ids[i] = x = new[r]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                q = rank(x << 32 | ids[k])
                if q is not None:
                    push(queue, q << 32 | i)
            h = before[i]
            if h >= 0:
                q = rank(ids[h] << 32 | x)
                if q is not None:
                    push(queue, q << 32 | h)
        return [x for x in ids if x >= 0]

    def word(self, text: str) -> bytes:
        """The ids of a text without white space, as 32-bit numbers one after another."""
        if self.by_letters and text.isascii():
            if text.isalpha():
                return self.tokens[text.lower()]
            if text[-1] in ".," and text[:-1].isalpha():
                return self.tokens[text[:-1].lower()] + self.tokens[text[-1]]
        out = []
        for part in self.specials.split(text) if "<" in text else (text,):
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            # Lower case letter by letter: a capital sigma has no final form here.
            flat = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += map(self.tokens.__getitem__, self.pattern.findall(flat))
        return b"".join(out)

    def token(self, text: str) -> bytes:
        """The ids of a pre-token."""
        raw = text.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return array("i", self.merge(ids)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        words = self.spaces.findall(text) if any(c in text for c in _NOT_SPACE) else text.split()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


class _Words(dict):
    """A function's values by word. When a number of words is reached they become the old generation, from which words
    still in use come back; the generation before goes. Long words are not kept."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


_loaded: dict[int, Bpe] = {}


def _tool(source: object) -> Bpe:
    """The Bpe of a broadcast file, one for each Python worker."""
    take_over("bpe", _release)
    key = source.id if hasattr(source, "id") else id(source)
    if key not in _loaded:
        _release()
        _loaded[key] = Bpe(source.value)
    return _loaded[key]


def _release() -> None:
    for tool in _loaded.values():
        # Tables of words refer to their Bpe, and would stay with it until the next collection of old objects.
        del tool.words, tool.tokens
    _loaded.clear()


def tokenizer_source(spark: SparkSession, path: str):
    """The tokenizer file at path, broadcast as text."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(source, text: Column) -> Column:
    """array<int> of the ids of a text."""

    def ids_of(texts: pa.Array) -> pa.Array:
        tool = _tool(source)
        ids = [tool.encode(t.as_py() or "") for t in texts]
        ends = np.zeros(len(ids) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in ids], out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))

    return F.arrow_udf(ids_of, "array<int>")(text)


def decode(source, ids: Column) -> Column:
    """The text of an array of ids."""

    def text_of(lists: pa.Array) -> pa.Array:
        tool = _tool(source)
        texts = [pa.array([], pa.string())]
        for some in slices(lists):
            ends = np.zeros(len(some) + 1, dtype=np.int64)
            np.cumsum(pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False), out=ends[1:])
            # All of a slice's ids at once: looked up, and put together list by list.
            found = pa.LargeListArray.from_arrays(pa.array(ends), tool.table.take(some.flatten()))
            texts.append(pc.binary_join(found, pa.scalar(" ", pa.large_string())).cast(pa.string()))
        return pa.concat_arrays(texts)

    return F.arrow_udf(text_of, "string")(ids)


def encoded(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of text_col in the column out."""
    return docs.withColumn(out, encode(tokenizer_source(docs.sparkSession, path), F.col(text_col)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    source = tokenizer_source(docs.sparkSession, path)
    rows = docs.select("doc_id", encode(source, F.col("text")).alias("ids"))
    rows = rows.withColumn("decoded", decode(source, F.col("ids")))
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_hex(written).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"))
