"""Operator 7: token counts at every prefix of a text, by dynamic programming.

Method: for a pre-token the last token of the encoding of each byte prefix is found from those of shorter
prefixes: of all tokens that end there, exactly one may follow the last token of the prefix before it (two
tokens may be neighbours if and only if their bytes together encode to just these two). Its count is one more.
The table of a word is kept for words that come again, and the prefix counts of a text are those of its
pre-tokens laid end to end over a running total. Two kinds of prefix end where the pre-tokens of the prefix are
not those of the text: inside a run of white space and inside a contraction. They are counted anew, so every
count equals that of encoding the prefix alone. Truncation and budget questions read the table.

Null text counts as empty: no tokens. Prefixes end between code points. Added tokens' strings inside a text
count as one token; prefixes that end within such a string count it as ordinary text. Rows are independent:
ties, repeated rows, null ids and other columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACES, Vocabulary, Words, vocabulary, words_of
from .common import text_of

CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    def __init__(self, v: Vocabulary):
        self.v = v
        #: Finds all tokens that end at a byte.
        self.ends = ahocorasick.Automaton()
        for i, t in v.tokens.items():
            if i not in v.added.values():
                self.ends.add_word(t.decode("latin-1"), (len(t), i))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        #: Word to its count at each prefix that ends between code points, as little-endian unsigned 32-bit integers.
        self.known = Words(self._table)

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            got = self.pairs[key] = self.v.word_ids(self.v.tokens[a] + self.v.tokens[b]) == [a, b]
        return got

    def _table(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        pairs, counts, end = self.pairs, [0], -1
        last = [-1] * (len(raw) + 1)
        for at, (length, token) in self.ends.iter(raw.decode("latin-1")):
            if at == end:
                continue  # the last token of this prefix is known
            start = at + 1 - length
            if start:
                fits = pairs.get(last[start] << 20 | token)
                if fits is None:
                    fits = self.may_follow(last[start], token)
                if not fits:
                    continue
            end = at
            last[at + 1] = token
            counts.append(counts[start] + 1)
        out = np.array(counts[1:], "<u4")
        if len(raw) != len(word):
            bytes_ = np.frombuffer(raw, np.uint8)
            out = out[np.append((bytes_[1:] & 0xC0) != 0x80, True)]
        if word in CONTRACTIONS:
            out[1] = 2  # the apostrophe and a letter
        return out.tobytes()

    def prefixes(self, text: str) -> np.ndarray:
        """The token count of text[:i] at i, for i from 0 to len(text)."""
        if self.v.split is not None and any(x in text for x in self.v.added):
            out = [np.zeros(1, np.int64)]
            for k, piece in enumerate(self.v.split.split(text)):
                more = self._plain(piece)[1:]
                if k % 2:
                    more[-1:] = 1
                out.append(out[-1][-1] + more if len(more) else out[-1][:0])
                if not len(out[-1]):
                    out.pop()
            return np.concatenate(out)
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        words = words_of(text)
        inside = np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4").astype(np.int64)
        if not len(inside):
            return np.zeros(1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        totals = np.cumsum(inside[ends - 1])
        out = np.empty(len(inside) + 1, np.int64)
        out[0] = 0
        out[1:] = inside + np.repeat(totals - inside[ends - 1], lengths)
        for k in [k for k, w in enumerate(words) if w[0] in SPACES]:
            # a word that begins with white space after a word of white space: its first prefix lengthens that run
            if k and words[k - 1][-1] in SPACES:
                at, run = int(ends[k] - lengths[k]), words[k - 1] + words[k][0]
                out[at + 1] = out[at - len(words[k - 1])] + np.frombuffer(self.known[run], "<u4")[-1]
        return out


@lru_cache(4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(vocabulary(path))


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """The most code points of a text whose tokens keep to the budget."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def token_counts(df: DataFrame, tokenizer_path: str, budget: int = 512, id_column: str = "doc_id", text_column: str = "text", with_prefixes: bool = False) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, and n_kept: how many code points keep to the budget; the whole table
    of counts as prefix_counts if asked for."""
    names = [id_column, "n_bytes", "n_tokens", "over_limit", "n_kept"] + ["prefix_counts"] * with_prefixes
    schema = f"{id_column} {df.schema[id_column].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, n_kept long" + ", prefix_counts array<int>" * with_prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for b in batches:
            sizes, totals, kept, tables = [], [], [], []
            for t in b.column(1):
                text = t.as_py()
                counts = c.prefixes(text)
                sizes.append(len(t.as_buffer()) if t.as_buffer() is not None else 0)
                totals.append(int(counts[-1]))
                kept.append(len(text) if counts[-1] <= budget else longest_prefix(counts, budget))
                if with_prefixes:
                    tables.append(counts)
            out = [b.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > budget for n in totals], pa.bool_()), pa.array(kept, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(tables, pa.list_(pa.int32()))] * with_prefixes, names)

    return df.select(id_column, text_of(text_column).alias("text")).mapInArrow(run, schema)
