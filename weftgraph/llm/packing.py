"""Operator 1: best-fit packing of token sequences, planned over the histogram of lengths.

Method: items are counted by length (a table of at most `capacity` rows, whatever the corpus). Best fit
decreasing runs over these counts, not over documents: bins that look alike are one entry with a number, so the
plan is as small as the histogram allows. The plan is a list of slots: for each length, ranges of ranks with the
first sequence, the place inside it, and how many of that length lie side by side. Items get their rank within
their length and take the slot of that rank by a join. A rank within a hot length is made of a rank within
(length, salt) and the counts of the salts before it, so no length meets in one task.

Nulls and edges: null text counts as empty (one token, the separator); items of null, zero or negative length
take no part in `pack_lengths`, items over the capacity raise an error there, while `pack_documents` cuts them.
Equal lengths, repeated rows and null ids are told apart by a row number of their own. An empty table gives an
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Words, pack_ids, words_of
from .common import materialise, text_of

#: Items of one length that share a salt, about.
PER_SALT = 20_000
#: Distinct pre-tokens whose ids a Python worker keeps, in each of two generations.
KEPT_WORDS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = "length long, first_rank long, items long, side_by_side long, first_sequence long, first_offset long"


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts. Rows as in SLOTS: item number r of a range lies in sequence
    first_sequence + r // side_by_side at first_offset + (r % side_by_side) * length."""
    bins: dict[int, list[tuple[int, tuple]]] = {}  # room left: [(how many bins, what they hold as (length, times) pairs)]
    rooms: list[int] = []

    def keep(room: int, number: int, held: tuple) -> None:
        if number:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((number, held))

    full: list[tuple[int, tuple]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                number, held = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
                times = min(room // length, left)  # an item that fits best here leaves the best place for the next of its length
                taken = min(number, left // times)
                keep(room, number - taken, held)
            else:
                room, held = capacity, ()
                times = min(capacity // length, left)
                taken = left // times
            left -= taken * times
            rest = room - times * length
            (full.append((taken, (*held, (length, times)))) if not rest else keep(rest, taken, (*held, (length, times))))
    slots, sequence, used = [], 0, dict.fromkeys(histogram, 0)
    for number, held in [*full, *(x for room in rooms for x in bins[room])]:
        offset = 0
        for length, times in held:
            slots.append((length, used[length], number * times, times, sequence, offset))
            used[length] += number * times
            offset += length * times
        sequence += number
    return slots


def pack_lengths(items: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """items with sequence_id and offset. items must be the same whenever it is read (a written table), and
    hold a unique long column `uid`."""
    spark = items.sparkSession
    over = items.where(F.col(length) > capacity).limit(1).count()
    if over:
        raise ValueError(f"an item is longer than {capacity}")
    items = items.where(F.col(length) > 0)
    total = items.count()
    salts = max(1, -(-total // PER_SALT))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    counts = salted.groupBy(F.col(length).alias("_l"), F.col("_salt").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["_l"]: r["n"] for r in counts.groupBy("_l").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(plan_slots(histogram, capacity), SLOTS)
    before = counts.select("_l", "_s", (F.sum("_n").over(Window.partitionBy("_l").orderBy("_s")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(length, "_salt").orderBy("uid")) - 1)
    ranked = ranked.join(before, (F.col(length) == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    s = F.broadcast(slots.withColumnRenamed("length", "_sl"))  # bounded by the capacity, not by the items
    placed = ranked.join(s, (F.col(length) == F.col("_sl")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("first_rank") + F.col("items")))
    r = F.col("_rank") - F.col("first_rank")
    return placed.select(
        *items.columns,
        (F.col("first_sequence") + F.floor(r / F.col("side_by_side"))).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(r, F.col("side_by_side")) * F.col(length)).alias("offset"),
    )


class LibraryIds:
    """The packed ids of texts by the tokenizers library, which is asked once for each distinct pre-token kept."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known = Words(lambda w: pack_ids(self.library.encode(w, add_special_tokens=False).ids), KEPT_WORDS)

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return pack_ids(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.known.__getitem__, words_of(text)))


_IDS: dict[str, LibraryIds] = {}


def library_ids(path: str) -> LibraryIds:
    if path not in _IDS:
        _IDS[path] = LibraryIds(path)
    return _IDS[path]


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int, separator: int, with_ids: bool = False) -> DataFrame:
    """The pieces of every document as PIECES says, and their ids if asked for."""
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = library_ids(tokenizer_path), pack_ids([separator])
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = ids_of(text.as_py()) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row = (doc, k, i, j - i, zlib.crc32(ids[4 * i : 4 * j]))
                    rows.append((*row, np.frombuffer(ids[4 * i : 4 * j], "<i4")) if with_ids else row)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(names), kinds, strict=False)], names)

    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 1024, separator: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece (and its ids, if asked for)."""
    pieces = token_pieces(documents, tokenizer_path, capacity, separator, with_ids)
    pieces = materialise(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack_lengths(pieces, capacity).drop("uid")
