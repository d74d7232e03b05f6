"""Operator 8: removal of repeated byte strings by induced suffix sorting over sampled suffixes.

Every byte that lies in a string of LENGTH bytes which also starts anywhere else, in any document, goes.

Method: sorting the suffixes of all bytes outside memory moves some fifty bytes for each byte of text. Here the
induction starts from a sample, as induced sorting starts from its left-most S-type suffixes, and all else is
induced from it:

1. Sample. Each window of LENGTH bytes names its anchor, the k-gram in it that is least in a fixed hash order
   (leftmost of equals). That depends on the window's bytes only, so equal windows name equal anchors at equal
   places; about one position in eighty is an anchor. Anchors whose k-gram occurs once in the corpus are done with:
   none of their windows repeats. Anchors whose whole surroundings are equal repeat in every window.
2. Sort. The anchors left over are sorted by k-gram and by the bytes that follow (Spark's external sort, which
   spills to disk, in the place of a disk-backed priority queue), and neighbours get their common-prefix values.
3. Induction. The suffix that begins one byte before an anchor's suffix is sorted by that byte and by the order
   already known; its common-prefix value is the least of those between its new neighbours, plus one. Repeated
   level by level this sorts every suffix that starts a window, and tuples (byte, rank, common prefix) are all that is
   carried. A window repeats when its suffix shares LENGTH bytes with a neighbour.

Hot k-grams: of one with more than IN_TASK different surroundings the windows are named by hash and counted by
aggregation instead, so no group has to fit in one task.

Null text counts as empty; texts shorter than LENGTH lose nothing. Matches never cross documents. Equal texts have
one key (64 bits of hash) and lose the same bytes; repeated rows count as copies of each other. doc_id may be null
and may repeat. Very long texts are read in overlapping stretches. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, text_of

LENGTH, GRAM = 200, 40
WIDTH = LENGTH - GRAM + 1  # k-grams in a window
IN_TASK = 20_000
#: Bytes that are hashed at once, some eighty bytes of memory for each; positions must fit in 24 bits.
STRETCH = 256 << 10
_U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random 64-bit value for each byte, the powers of the base, and those of its inverse."""
    letters = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
    n = STRETCH + 1
    powers, inverse = np.full(n, _B, _U), np.full(n, pow(_B, -1, 1 << 64), _U)
    powers[0] = inverse[0] = 1
    return letters, np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


def stretches(texts: Iterable[bytes], most: int = STRETCH) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lots of (text number, start, bytes) of at most `most` bytes; those of one text overlap by LENGTH - 1."""
    lot, held = [], 0
    for k, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        at = 0
        while True:
            piece = t[at : at + most // 2]
            if held + len(piece) > most and lot:
                yield lot
                lot, held = [], 0
            lot.append((k, at, piece))
            held += len(piece)
            if at + len(piece) >= len(t):
                break
            at += len(piece) - LENGTH + 1
    if lot:
        yield lot


def anchors(lot: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Of each anchor: key, hash of its surroundings, text number, place in the text, and the least and the most
    bytes that its windows begin before it."""
    letters, powers, inverse = tables()
    data = letters[np.frombuffer(b"".join(p for _, _, p in lot), np.uint8)]
    n = len(data)
    sums = np.zeros(n + 1, _U)
    np.cumsum(data * powers[:n], out=sums[1:])
    gram = mix((sums[GRAM:] - sums[: n - GRAM + 1]) * inverse[: n - GRAM + 1])
    low = (gram & ~_U(0xFFFFFF)) | np.arange(len(gram), dtype=_U)
    size = 1
    while size * 2 <= WIDTH:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < WIDTH:
        low = np.minimum(low[: len(low) - (WIDTH - size)], low[WIDTH - size :])
    at = (low & _U(0xFFFFFF)).astype(np.int64)
    lengths = np.array([len(p) for _, _, p in lot], np.int64)
    starts = np.cumsum(lengths) - lengths
    piece = np.repeat(np.arange(len(lot)), lengths)[: len(at)]
    fits = np.arange(len(at)) + LENGTH <= (starts + lengths)[piece]
    first = fits.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~fits[:-1] | (piece[1:] != piece[:-1])
    last = fits.copy()
    last[:-1] &= first[1:] | ~fits[1:]
    s0, s1 = np.flatnonzero(first), np.flatnonzero(last)
    a, own = at[s0], piece[s0]
    around = mix((sums[s1 + LENGTH] - sums[s0]) * inverse[s0] + mix(((a - s0) * 1024 + (a - s1)).astype(_U)))
    number = np.array([k for k, _, _ in lot], np.int64)
    begin = np.array([b for _, b, _ in lot], np.int64)
    return mix(gram[a] + _U(1)), around, number[own], a - starts[own] + begin[own], a - s1, a - s0


ANCHORS = "key long, around long, doc long, pos long, lo int, hi int"


def _anchors_of(texts: DataFrame) -> DataFrame:
    names, most = [x.split()[0] for x in ANCHORS.split(", ")], STRETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            raw = (t.as_buffer().to_pybytes() if t.as_buffer() is not None else b"" for t in b.column(1))
            for lot in stretches(raw, most):
                key, around, k, pos, lo, hi = anchors(lot)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), pa.array(keys[k]), pa.array(pos), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names)

    return texts.mapInArrow(run, ANCHORS)


def induce(key: np.ndarray, right: list[bytes], left: list[bytes], lo: np.ndarray, hi: np.ndarray) -> list[list[int]]:
    """For rows sorted by (key, right): at which levels (bytes before the anchor) a window repeats.

    right holds the bytes from the anchor on, left those before it, nearest first."""
    n, most = len(key), LENGTH - GRAM
    r = np.zeros((n, LENGTH), np.uint8)
    rlen = np.fromiter(map(len, right), np.int64, n)
    filled = np.arange(LENGTH) < rlen[:, None]
    r[filled] = np.frombuffer(b"".join(right), np.uint8)
    llen = np.fromiter(map(len, left), np.int64, n)
    before = np.zeros((n, max(1, int(llen.max(initial=0)))), np.uint8)
    before[np.arange(before.shape[1]) < llen[:, None]] = np.frombuffer(b"".join(left), np.uint8)
    unlike = (r[1:] != r[:-1]) | ~filled[1:] | ~filled[:-1]
    # common bytes behind the k-gram; k-grams that only share their hash have less than none
    common = np.where(unlike.any(1), unlike.argmax(1), LENGTH) - GRAM
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(key[1:] == key[:-1], np.maximum(common, -1), -1)
    lcp[0] = -1
    order, group = np.arange(n), np.cumsum(lcp < 0)
    found: list[list[int]] = [[] for _ in range(n)]
    for level in range(most + 1):
        if level:
            keep = np.flatnonzero(hi[order] >= level)
            code = group[keep] * 256 + before[order[keep], level - 1]
            by = np.argsort(code, kind="stable")
            q, code = keep[by], code[by]
            same = np.append(False, code[1:] == code[:-1])
            # the common prefix with the new neighbour is the least of those between the two
            new = np.full(len(q), -1, np.int64)
            i = np.flatnonzero(same)
            new[i] = range_least(lcp, q[i - 1] + 1, q[i])
            order, lcp = order[q], new
            group = np.cumsum(~same) if len(q) else np.zeros(0, np.int64)
        alone = lcp < 0
        alone[:-1] &= lcp[1:] < 0
        if alone.any():
            stay = ~alone
            order, lcp, group = order[stay], lcp[stay], group[stay]
        if not len(order):
            break
        need = most - level
        best = lcp.copy()
        best[:-1] = np.maximum(best[:-1], lcp[1:])
        for x in order[(best >= need) & (lo[order] <= level)].tolist():
            found[x].append(level)
    return found


def range_least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a..b]) for each pair, both ends included: a sparse table."""
    if not len(a):
        return np.zeros(0, x.dtype)
    span = b - a + 1
    power = np.floor(np.log2(span)).astype(np.int64)
    out, table = np.empty(len(a), x.dtype), x
    for p in range(int(power.max()) + 1):
        if p:
            table = np.minimum(table[: len(table) - (1 << p - 1)], table[1 << p - 1 :])
        at = power == p
        out[at] = np.minimum(table[a[at]], table[b[at] - (1 << p) + 1])
    return out


def runs(levels: list[int]) -> Iterator[tuple[int, int]]:
    """Ascending levels as (first, last) of unbroken runs."""
    start = before = None
    for v in levels:
        if before is None or v != before + 1:
            if start is not None:
                yield start, before
            start = v
        before = v
    if start is not None:
        yield start, before


SPANS = "doc long, start long, stop long"


def _solve(contexts: DataFrame) -> DataFrame:
    """Spans of the single anchors among contexts: groups of a key in tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(part: pd.DataFrame) -> pd.DataFrame:
            found = induce(part["key"].to_numpy(), part["right"].tolist(), part["left"].tolist(), part["lo"].to_numpy(), part["hi"].to_numpy())
            rows = [(d, p - last, p - first + LENGTH) for d, p, single, levels in zip(part["doc"], part["pos"], part["single"], found, strict=True) if single for first, last in runs(levels)]
            return pd.DataFrame(rows, columns=["doc", "start", "stop"])

        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            held.append(f)
            if sum(map(len, held)) >= IN_TASK:
                part = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted((part["key"] == part["key"].iloc[-1]).to_numpy(), True))
                if cut:
                    yield close(part.iloc[:cut].reset_index(drop=True))
                    part = part.iloc[cut:].reset_index(drop=True)
                held = [part]
        if held:
            yield close(pd.concat(held, ignore_index=True))

    return contexts.repartition("key").sortWithinPartitions("key", "right").mapInPandas(run, SPANS)


def _count_windows(contexts: DataFrame) -> DataFrame:
    """The same for hot keys: each window is a row named by hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, doc, pos, single, lo, hi, left, right in zip(f["key"], f["doc"], f["pos"], f["single"], f["lo"], f["hi"], f["left"], f["right"], strict=True):
                ahead = left[::-1]
                for level in range(lo, hi + 1):
                    window = hashlib.blake2b(ahead[len(ahead) - level :] + b"|" + right[: LENGTH - level], digest_size=8, key=int(key).to_bytes(8, "little", signed=True)).digest()
                    rows.append((int.from_bytes(window, "little", signed=True), key, doc, pos, level, single))
            yield pd.DataFrame(rows, columns=["name", "key", "doc", "pos", "level", "single"])

    named = contexts.mapInPandas(run, "name long, key long, doc long, pos long, level int, single boolean")
    again = named.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hit = named.where("single").join(again, ["key", "name"], "left_semi")
    return hit.select("doc", (F.col("pos") - F.col("level")).alias("start"), (F.col("pos") - F.col("level") + LENGTH).alias("stop"))


def repeated_spans(df: DataFrame) -> DataFrame:
    """doc (hash of the text), spans: array of (start, stop) byte ranges that windows found again cover."""
    texts = df.select(F.xxhash64(text_of()).alias("doc"), text_of().alias("text")).where(F.octet_length("text") >= LENGTH)
    found = materialise(_anchors_of(texts), "all-anchors")
    again = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    left = materialise(found.join(materialise(again, "again"), "key", "left_semi"), "anchors")
    # sums are written before they are joined: a join that reads tables only can split a key that half of all rows hold
    kinds = materialise(left.groupBy("key", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("doc", "pos")).alias("rep")), "kinds")
    mixed = materialise(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed")
    kinds = materialise(kinds.join(mixed, "key", "left"), "kinds")
    marked = materialise(left.join(kinds, ["key", "around"]).withColumn("single", F.col("n") == 1), "marked")
    sure = marked.where(~F.col("single")).select("doc", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + LENGTH).alias("stop"))
    shown = marked.where(F.col("kinds").isNotNull() & (F.xxhash64("doc", "pos") == F.col("rep"))).dropDuplicates(["key", "around"])
    wanted = materialise(shown.groupBy("doc").agg(F.collect_list(F.struct("key", "pos", "lo", "hi", "single", "kinds")).alias("wanted")), "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc", "pos", "lo", "hi", "single", "kinds", "left", "right"]
        for b in batches:
            rows = []
            for doc, text, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for w in wanted:
                    p = w["pos"]
                    ahead, after = raw[p - w["hi"] : p][::-1], raw[p : p + LENGTH - w["lo"]]
                    rows.append((w["key"], doc, p, w["lo"], w["hi"], w["single"], w["kinds"], ahead, after))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 9, kinds, strict=True)], names)

    contexts = texts.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(cut, "key long, doc long, pos long, lo int, hi int, single boolean, kinds long, left binary, right binary")
    # an anchor near the seam of two stretches comes twice, each time with other windows
    contexts = materialise(contexts.dropDuplicates(["key", "doc", "pos", "lo", "hi"]), "contexts")
    spans = sure.unionByName(_solve(contexts.where(F.col("kinds") <= IN_TASK))).unionByName(_count_windows(contexts.where(F.col("kinds") > IN_TASK)))
    return spans.distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal removed runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remaining(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(raw[i:j] for i, j in zip(ends, [*(a for a, _ in spans), len(raw)], strict=True))


def _with_spans(df: DataFrame) -> DataFrame:
    spans = materialise(repeated_spans(df), "spans")
    keyed = df.withColumn("_key", F.xxhash64(text_of()))
    return keyed.join(spans.withColumnRenamed("spans", "_spans").withColumnRenamed("doc", "_key"), "_key", "left").drop("_key")


def repeat_digests(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw, gone = text.as_py().encode(), merged(spans or [])
                kept = remaining(raw, gone)
                rows.append((doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _with_spans(df.select("doc_id", text_of().alias("text"))).select(F.col("doc_id").cast("long"), "text", "_spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(df: DataFrame, column: str = "text") -> DataFrame:
    """df with the repeated bytes taken out of its text; what is left of a character that was cut goes too."""
    names = df.columns

    def left(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None or not len(s) else remaining(t.encode(), merged(list(s))).decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)])

    joined = _with_spans(df.select(F.struct(*names).alias("_row"), F.col(column).alias("text")))
    return joined.select("_row.*", F.pandas_udf(left, "string")("text", "_spans").alias("_new")).select(*[F.col("_new").alias(c) if c == column else F.col(c) for c in names])
