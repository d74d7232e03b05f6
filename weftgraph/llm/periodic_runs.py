"""Operator 12: periodic runs of words, by a vectorised scan of all lags.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of at least `min_length` words
and `min_exponent` periods, that no neighbouring word extends. A word is dropped if a run contains it behind the run's
first q words.

Method: words become ids, and the array of ids is compared with itself shifted by each lag up to n / min_exponent;
stretches of equality, taken by their lengths, are the runs of that lag. A run of lag q shows as at least
(min_exponent - 1) * q hits in a row, so the lags from q to 2q are first compared on every (q / PER_LAG)-th word only,
where it still shows as PER_LAG * (min_exponent - 1) - 1 hits in a row; a lag at which that happens is compared in full.
All lags of a text of n words so cost about n * log(n) comparisons, unless its words repeat very much. Lags that are
multiples of a run's period find the same stretch again; of equal stretches the least lag counts, as two periods of one
stretch that long are multiples of its smallest.

Texts of more than LONG characters are dealt over the cluster by ranges of lags, each range one row with the text; what
the ranges find is put together for each text. Words are separated by space, tab and the other controls from U+0009 to
U+000D. Null texts count as empty: no words, no runs. Every row is handled by itself: ties and repeated rows change
nothing, null ids stay, other columns are neither read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Texts of more characters than this are dealt over tasks by ranges of lags.
LONG = 60_000
#: Words in a lag, at least, that the first comparison looks at.
PER_LAG = 4
#: Cells of a comparison that are held at a time.
CELLS = 1 << 18
RUNS = "array<struct<start:long,length:long,period:long>>"


def word_ids(text: str) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and equal numbers for equal words."""
    words = text.encode().split()
    known: dict[bytes, int] = {}
    return words, np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def octaves(n: int, min_exponent: int) -> list[tuple[int, int]]:
    """The lags from 1 to n / min_exponent, cut at the powers of two."""
    last, out, q = n // min_exponent, [], 1
    while q <= last:
        out.append((q, min(2 * q, last + 1)))
        q *= 2
    return out


def lags_of(n: int, min_exponent: int, part: int, parts: int) -> list[tuple[int, int]]:
    """The part-th of so many ranges of lags: each takes its share of every octave, as octaves cost the same."""
    out = []
    for a, b in octaves(n, min_exponent):
        lo, hi = a + (b - a) * part // parts, a + (b - a) * (part + 1) // parts
        if lo < hi:
            out.append((lo, hi))
    return out


def _stretches(ids: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of equality at a lag, those of so many words at least."""
    same = np.empty(len(ids) - lag + 2, bool)
    same[0] = same[-1] = False
    np.equal(ids[:-lag], ids[lag:], out=same[1:-1])
    turns = np.flatnonzero(same[1:] != same[:-1])
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    long = lengths >= least
    return starts[long], lengths[long]


def _hits(ids: np.ndarray, first: int, behind: int, min_exponent: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(lag, places, reach): the lags that show enough hits in a row, and the word where each row of hits begins."""
    step = max(1, first // PER_LAG)
    row = max(1, ((min_exponent - 1) * first) // step - 1)
    at = np.arange(0, len(ids) - first, step)
    width = max(1, CELLS // max(1, len(at)))
    padded = np.concatenate([ids, np.full(behind, -1, np.int32)])
    for lo in range(first, behind, width):
        lags = np.arange(lo, min(lo + width, behind))
        same = ids[at][None, :] == padded[at[None, :] + lags[:, None]]
        # hits in a row, by doubling: held[i] says that `have` hits follow one another from i on
        held, have = same, 1
        while have < row and held.shape[1]:
            more = min(have, row - have)
            held = held[:, : held.shape[1] - more] & held[:, more:]
            have += more
        for k in np.flatnonzero(held.any(1)) if held.shape[1] else ():
            yield int(lags[k]), at[np.flatnonzero(held[k])], (row - 1) * step


def find_runs(ids: np.ndarray, ranges: list[tuple[int, int]], min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the stretches of the lags in these ranges; of equal stretches that of the least lag."""
    found: dict[tuple[int, int], int] = {}
    # the run seen last at each word: its period and the word behind it
    period, end = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for first, behind in ranges:
        for lag, places, reach in _hits(ids, first, behind, min_exponent):
            known = period[places]
            again = (known > 0) & (lag % np.maximum(known, 1) == 0) & (places + reach + lag < end[places])
            if again.all():
                continue
            for start, length in zip(*(x.tolist() for x in _stretches(ids, lag, max(min_length - lag, (min_exponent - 1) * lag))), strict=True):
                if found.setdefault((start, length + lag), lag) == lag:
                    period[start : start + length + lag] = lag
                    end[start : start + length + lag] = start + length + lag
    return [(s, n, q) for (s, n), q in found.items()]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains behind its first period."""
    if not runs:
        return words
    # changes of the number of runs that drop a word, summed up
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def _rows(ids: pa.Array, counts: list[int], runs: list[list], texts: list[str]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])


def _in_one(df: DataFrame, kind: str, min_length: int, min_exponent: int) -> DataFrame:
    """id, n_words, runs and collapsed of texts that one task scans at all lags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, all_runs, texts = [], [], []
            for text in b.column(1):
                words, ids = word_ids(text.as_py())
                runs = sorted(find_runs(ids, octaves(len(ids), min_exponent), min_length, min_exponent))
                counts.append(len(words))
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(kept_words(words, runs)).decode())
            yield _rows(b.column(0), counts, all_runs, texts)

    return df.mapInArrow(run, f"id {kind}, n_words long, runs {RUNS}, collapsed string")


def _in_ranges(df: DataFrame, kind: str, min_length: int, min_exponent: int) -> DataFrame:
    """The same of long texts: ranges of lags are dealt out, and their runs meet at their text."""
    spark = df.sparkSession
    named = df.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    parts = F.ceil(F.length("text") / LONG).cast("int")
    dealt = named.dropDuplicates(["id", "sha"]).select("id", "sha", "text", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for k in range(b.num_rows):
                _, ids = word_ids(b.column(2)[k].as_py())
                runs = find_runs(ids, lags_of(len(ids), min_exponent, b.column(4)[k].as_py(), b.column(3)[k].as_py()), min_length, min_exponent)
                found += runs
                at += [k] * len(runs)
            whose = b.select([0, 1]).take(pa.array(at, pa.int64()))
            columns = [pa.array([r[i] for r in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, *whose.columns], ["start", "length", "period", "id", "sha"])

    found = dealt.repartition(spread, "id", "sha", "part").mapInArrow(run, f"start long, length long, period long, id {kind}, sha string")
    # the runs of one text are fewer than its words, and the text is one value
    least = found.groupBy("id", "sha", "start", "length").agg(F.min("period").alias("period"))
    of_text = least.groupBy(F.col("id").alias("_id"), F.col("sha").alias("_sha")).agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    both = named.join(of_text, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    both = both.select("id", "text", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, all_runs, texts = [], b.column(2).to_pylist(), []
            for text, runs in zip(b.column(1), all_runs, strict=True):
                words = text.as_py().encode().split()
                counts.append(len(words))
                texts.append(b" ".join(kept_words(words, [(r["start"], r["length"], r["period"]) for r in runs])).decode())
            yield _rows(b.column(0), counts, all_runs, texts)

    return both.mapInArrow(collapse, f"id {kind}, n_words long, runs {RUNS}, collapsed string")


def periodic_runs(df: DataFrame, min_length: int = 6, min_exponent: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every text: runs by start, then period; collapsed is the kept words joined by
    one space. min_exponent: an integer of 2 or more; below that, equal stretches may have unrelated periods."""
    if min_exponent < 2:
        raise ValueError("min_exponent must be 2 or more")
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    short, long = F.length("text") <= LONG, F.length("text") > LONG
    out = _in_one(rows.where(short), kind, min_length, min_exponent).unionByName(_in_ranges(rows.where(long), kind, min_length, min_exponent))
    return out.withColumnRenamed("id", id_column)
