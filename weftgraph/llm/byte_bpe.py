"""Operator 13: byte-level BPE by the tokenizers library, from a file of ranks.

Method: the file's ranks become a model of the tokenizers library. A token's bytes are mapped to printable letters, as
byte-level vocabularies spell them. Its merge is the last pair that is left when its own bytes are merged by rank: the
merges inside a stretch of bytes come in the same order wherever no merge crosses its ends, so whenever a token comes
about, it is from that pair, and merges in the order of ranks give what ranks give. Tokens that no merge reaches are
found whole only, as a rank look-up does. Texts come in Arrow batches and are cut by the pattern; the library encodes
each batch's unseen pieces, maps their bytes to letters and tells the characters that each token covers. Decoding
reverses the table of letters: tokens are gathered as bytes, so characters that are split over tokens come whole again;
`pieces` gives a split character to the token that completes it.

Texts: null counts as empty; an empty text has no ids. There are no special tokens: their strings are ordinary text.
Texts of any length go through in stretches of about STRETCH characters, cut before a space that follows a letter or
digit, where the pattern never matches across. Every row is handled on its own: ties, repeated rows and null ids change
nothing, other columns of the input are neither read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from .bpe import LONG, byte_letters, pack_ids, words_of
from .common import text_of

#: Characters that are cut into words at a time.
STRETCH = 1 << 20
#: Distinct words of at most LONG characters whose ids a Python worker keeps.
KEPT_WORDS = 400_000
_SEAM = re.compile(r"(?<=[0-9A-Za-z]) ")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that are left when a token's bytes are merged by rank; None if more are."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        pairs = [ranks.get(a + b, len(ranks)) for a, b in zip(parts, parts[1:])]  # noqa: B905
        least = min(pairs)
        if least == len(ranks):
            return None
        at = pairs.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def stretches(text: str) -> Iterator[str]:
    """A text in pieces that the pattern never matches across."""
    at = 0
    while len(text) - at > STRETCH:
        seam = _SEAM.search(text, at + STRETCH)
        if seam is None:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


class ByteBpe:
    def __init__(self, path: str):
        ranks = read_ranks(path)
        letter = {b: c for c, b in byte_letters().items()}
        spelt = {t: "".join(map(letter.__getitem__, t)) for t in ranks}
        pairs = (last_pair(t, ranks) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1)
        merges = [(spelt[a], spelt[b]) for a, b in filter(None, pairs) if a in spelt and b in spelt]
        self.library = Tokenizer(models.BPE(vocab={spelt[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        # pieces are cut before, by the pattern; the library maps their bytes to letters
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # decoding: the letters of each id as bytes again, all of them laid end to end
        by_letter = byte_letters()
        vocabulary = self.library.get_vocab()
        tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for spelling, i in vocabulary.items():
            tokens[i] = bytes(map(by_letter.__getitem__, spelling))
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.laid = np.frombuffer(b"".join(tokens), np.uint8)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids, as little-endian unsigned 32-bit integers."""
        cut = [words_of(s) for t in texts for s in stretches(t)]
        owner = [i for i, t in enumerate(texts) for _ in stretches(t)]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        fresh = list({w for words in cut for w in words}.difference(self.known))
        coded = {w: pack_ids(e.ids) for w, e in zip(fresh, self.library.encode_batch_fast(fresh, add_special_tokens=False), strict=True)}
        self.known.update((w, ids) for w, ids in coded.items() if len(w) <= LONG)
        long = {w: ids for w, ids in coded.items() if len(w) > LONG}
        out: list[list[bytes]] = [[] for _ in texts]
        for i, words in zip(owner, cut, strict=True):
            get = self.known.__getitem__ if not long else lambda w: long[w] if w in long else self.known[w]
            out[i].append(b"".join(map(get, words)))
        return [b"".join(parts) for parts in out]

    def offsets(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids of a text, and of each the first character that its bytes touch and the one behind the last."""
        ids, first, behind, at = [], [], [], 0
        for stretch in stretches(text):
            words = words_of(stretch)
            for w, e in zip(words, self.library.encode_batch(words, add_special_tokens=False), strict=True):
                ids += e.ids
                first += [at + a for a, _ in e.offsets]
                behind += [at + b for _, b in e.offsets]
                at += len(w)
        return ids, first, behind

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids: a gather over all tokens laid end to end."""
        at = np.frombuffer(ids, "<u4")
        lengths = self.lengths[at]
        before = np.cumsum(lengths) - lengths
        return self.laid[np.arange(int(lengths.sum())) + np.repeat(self.starts[at] - before, lengths)].tobytes()

    def pieces(self, ids: list[int]) -> list[str]:
        """The text of each id. A character split over tokens is its last token's; bytes that are no UTF-8 become U+FFFD."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.tokens[i], k == len(ids) - 1) for k, i in enumerate(ids)]


@lru_cache(2)
def tokenizer(path: str) -> ByteBpe:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    return ByteBpe(path)


def batches_of(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in lists of about STRETCH characters."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_texts(df: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, starts, ends, pieces, decoded) of every text: ids and, of each, its characters and its text; decoded is
    binary. The general form of the operator."""
    schema = f"{id_column} {df.schema[id_column].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>, pieces array<string>, decoded binary"
    names = [id_column, "ids", "starts", "ends", "pieces", "decoded"]
    kinds = [pa.list_(pa.int32())] * 3 + [pa.list_(pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks_path)
        for b in batches:
            for k, text in enumerate(b.column(1)):
                ids, first, behind = t.offsets(text.as_py())
                row = (ids, first, behind, t.pieces(ids), t.decode(pack_ids(ids)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *(pa.array([x], kind) for x, kind in zip(row, kinds, strict=True))], names)

    return df.select(id_column, text_of(text_column).alias("text")).mapInArrow(run, schema)


def encode_digests(df: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, without moving ids or texts back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks_path)
        for b in batches:
            counts, of_ids, of_bytes = [], [], []
            for texts in batches_of(b.column(1).to_pylist()):
                for ids in t.encode(texts):
                    counts.append(len(ids) // 4)
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_bytes.append(hashlib.sha256(t.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
