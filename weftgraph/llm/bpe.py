"""Operator 4: byte-level BPE encoding and decoding over a public vocabulary file.

Method: a contiguous rank array. A short word keeps its parts and the merge ranks of adjacent parts in two
small lists; the least rank is searched again and again, the boundary there is deleted and the ranks beside it
are refreshed. Words of more than LONG bytes, for which the repeated search would be quadratic, take a heap
with linked parts and give the same ids.

Texts: null counts as empty; an empty text has no ids. The strings of added tokens inside texts become their
ids, as the library does by default. Every row is handled on its own: ties, repeated rows and null doc_ids
change nothing, other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LONG = 96
NO_RANK = 1 << 30
#: Distinct words whose ids a Python worker keeps, in each of two generations.
KEPT_WORDS = 400_000

# Fixed value: the pre-tokenising pattern that the byte_bpe_50k vocabulary was made with.
EXACT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space as EXACT has it.
SPACES = frozenset(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
BEYOND = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(1)
def fast() -> re.Pattern:
    """EXACT for texts up to U+FFFF, its classes spelled out as ranges: the standard engine is faster with them."""

    def ranges(of: str) -> str:
        kind, out = regex.compile(of), []
        for i in range(0x10000):
            if not 0xD800 <= i < 0xE000 and kind.match(chr(i)):
                if out and out[-1][1] == i - 1:
                    out[-1][1] = i
                else:
                    out.append([i, i])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)

    le, nu, sp = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    return re.compile(rf" ?[{le}]+|'(?:[stmd]|re|ve|ll)| ?[{nu}]+| ?[^{sp}{le}{nu}]+|[{sp}]+(?![^{sp}])|[{sp}]+")


def words_of(text: str) -> list[str]:
    """The pre-tokens; joined they are the text."""
    return (fast() if text.isascii() or BEYOND.search(text) is None else EXACT).findall(text)


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by letter."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """What make() gives for each word; of short words, up to two generations of `most` are kept."""

    def __init__(self, make, most: int = KEPT_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= LONG:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class Vocabulary:
    """Ids, merges and added tokens of a byte-level BPE file for the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        self.tokens: dict[int, bytes] = {i: bytes(map(letters.__getitem__, t)) for t, i in file["model"]["vocab"].items() if all(c in letters for c in t)}
        ids = {t: i for i, t in self.tokens.items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        #: The rank of a pair of adjacent ids (left << 20 | right), and the id that the merge of a rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = (bytes(map(letters.__getitem__, x)) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.ranks[ids[left] << 20 | ids[right]] = rank
            self.made.append(ids[left + right])
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        for text, i in self.added.items():
            self.tokens[i] = text.encode()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        in_order = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.lengths = np.array([len(t) for t in in_order], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.laid = np.frombuffer(b"".join(in_order), np.uint8)
        #: Word to its ids as little-endian unsigned 32-bit integers.
        self.packed = Words(lambda word: pack_ids(self.word_ids(word.encode("utf-8", "surrogatepass"))))

    def word_ids(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        parts = [self.byte_ids[b] for b in word]
        return self._by_array(parts) if len(parts) <= LONG else self._by_heap(parts)

    def _by_array(self, parts: list[int]) -> list[int]:
        get, none, made = self.ranks.get, NO_RANK, self.made
        ranks = [get(a << 20 | b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == none:
                break
            at = ranks.index(least)
            new = parts[at] = made[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] << 20 | new, none)
            if at < len(ranks):
                ranks[at] = get(new << 20 | parts[at + 1], none)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        n, get, made = len(parts), self.ranks.get, self.made
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get(a << 20 | b)) is not None]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = made[rank], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := get(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed; of added tokens too."""
        if self.split is not None and any(x in text for x in self.added):
            pieces = self.split.split(text)
            return b"".join(pack_ids([self.added[x]]) if k % 2 else self._plain(x) for k, x in enumerate(pieces))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, words_of(text)))

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        return self.joined(np.frombuffer(ids, "<u4")).decode("utf-8", "replace")

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of ids one after another: a gather over the vocabulary laid end to end."""
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        before = np.cumsum(lengths) - lengths
        return self.laid[np.arange(total) + np.repeat(self.starts[ids] - before, lengths)].tobytes()


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every text: the general form of the operator."""
    schema = f"{id_column} {df.schema[id_column].dataType.simpleString()}, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer_path)
        for b in batches:
            packed = [v.encode(t) for t in b.column(1).to_pylist()]
            ids = pa.array([np.frombuffer(p, "<i4") for p in packed], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([v.decode(p) for p in packed], pa.string())], [id_column, "ids", "decoded"])

    return df.select(id_column, text_of(text_column).alias("text")).mapInArrow(run, schema)


def encode_digests(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, without moving ids or texts back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer_path)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                packed = v.encode(t.as_py())
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(v.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
