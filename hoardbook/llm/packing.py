"""Packing documents into windows: overlong documents are cut into full windows, and what is left
of each document goes to the tightest open window, longest pieces first.

Pieces of one length are interchangeable, so best fit decreasing needs only how many pieces each
length has: at most ``window`` numbers, whatever the corpus holds. The plan is computed from those
counts by runs of equal decisions, over a segment tree indexed by remaining capacity, and covers
the whole corpus at once: no window is lost at the border of a partition. Pieces then find their place
by their rank among pieces of their length.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hoardbook.llm.bpe import group_encoder
from hoardbook.llm.common import extended, staged, with_place

WINDOW = 4096


class FreeSpace:
    """Segment tree over remaining capacities 0..window: which capacities have open windows."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)

    def set(self, capacity: int, some: bool) -> None:
        at = self.leaves + capacity
        self.tree[at] = some
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open window."""
        at = self.leaves + least
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing of ``counts`` (length -> number of pieces) into windows.

    Returns slots (length, first rank, pieces, first window, pieces per window, offset): pieces
    of that length with ranks from the first on fill windows one after another, ``pieces per
    window`` into each, from ``offset`` on. Windows with the same content form a run; one step
    places pieces into a whole run, so the work depends on the number of lengths, not of pieces.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # capacity left -> runs (first window, windows)
    free, slots, windows = FreeSpace(window), [], 0

    def put(capacity: int, first: int, n: int) -> None:
        runs.setdefault(capacity, []).append((first, n))
        free.set(capacity, True)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = free.tightest(length)
            if capacity is None:  # new windows: each takes as many pieces as it holds
                each = window // length
                n = left // each
                if n:
                    slots.append((length, rank, n * each, windows, each, 0))
                    put(window - each * length, windows, n)
                    windows, rank, left = windows + n, rank + n * each, left - n * each
                if left:
                    slots.append((length, rank, left, windows, left, 0))
                    put(window - left * length, windows, 1)
                    windows, left = windows + 1, 0
                continue
            first, n = runs[capacity].pop()
            if not runs[capacity]:
                free.set(capacity, False)
            # The tightest window stays the tightest until the piece no longer fits into it.
            each = min(capacity // length, left)
            use = min(n, left // each)
            slots.append((length, rank, use * each, first, each, window - capacity))
            put(capacity - each * length, first, use)
            rank, left = rank + use * each, left - use * each
            if use < n:
                put(capacity, first + use, n - use)
    return slots


def _pieces(tokenizer: str, window: int, end_id: int, with_ids: bool):
    def run(batches):
        encode = group_encoder(tokenizer)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            rows, starts, lengths, sums, totals, ids = [], [], [], [], [], []
            for row, data in enumerate(encode([text or "" for text in texts])):
                data += end
                n = len(data) // 4
                for start in range(0, n, window):
                    part = data[4 * start:4 * (start + window)]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4"))
            kept = batch.drop_columns(["_text"]).take(pa.array(rows, pa.int64()))
            out = [
                pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()), pa.array(totals, pa.int64()),
            ]
            names = ["start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                flat = np.concatenate(ids) if ids else np.empty(0, "<u4")
                cuts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(kept.columns + out, kept.schema.names + names)

    return run


def cut_pieces(
    docs: DataFrame, keys: list[str], tokenizer: str, window: int = WINDOW, end_id: int = 2,
    with_ids: bool = True, text: str = "text",
) -> DataFrame:
    """The pieces of each document: ``keys``, start, length, ids_crc32, doc_tokens and, if asked
    for, ``ids``. A document is its text's ids, then ``end_id``; a null text counts as empty."""
    numbers = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    schema = extended(docs.select(*keys), numbers + (", ids array<int>" if with_ids else ""))
    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(
        _pieces(tokenizer, window, end_id, with_ids), schema
    )


def place(pieces: DataFrame, window: int = WINDOW, rows_per_bucket: int = 1_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (``length`` from 1 to ``window``).

    Full windows come first, one sequence each; the others follow by ``best_fit``. Every piece
    has one place, places in a sequence are gapless from 0. Equal rows take different places;
    an empty table stays empty. Sequences number from 0 without gaps.
    """
    rows = staged(
        pieces.withColumn("_id", F.monotonically_increasing_id()), "pieces"
    ).withColumn("_hash", F.md5(F.col("_id").cast("string"))).withColumn("_one", F.lit(1).cast("bigint"))
    counts = {
        r["length"]: r["n"]
        for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    }  # at most ``window`` numbers
    full = counts.pop(window, 0)
    slots = [(window, 0, full, 0, 1, 0)] if full else []
    slots += [(n, rank, k, first + full, each, at) for n, rank, k, first, each, at in best_fit(counts, window)]
    spark = pieces.sparkSession
    table = spark.createDataFrame(
        slots, "_length bigint, _first bigint, _pieces bigint, _window bigint, _each bigint, _offset bigint"
    )
    # A piece's slot is the last one of its length that starts at or before its rank: the slots of a
    # length are an array, searched per row.
    by_length = table.groupBy("_length").agg(F.sort_array(F.collect_list(
        F.struct("_first", "_window", "_each", "_offset")
    )).alias("_slots"))
    ranked = with_place(rows, ["length"], "_hash", ["_id"], {"_rank": "_one"}, rows_per_bucket)
    slot = F.element_at(F.filter("_slots", lambda s: s["_first"] <= F.col("_rank")), -1)
    inside = F.col("_rank") - F.col("_slot._first")
    return (
        ranked.join(F.broadcast(by_length), F.col("length") == F.col("_length"))
        .withColumn("_slot", slot)
        .withColumn("sequence_id", F.col("_slot._window") + F.floor(inside / F.col("_slot._each")))
        .withColumn("offset", F.col("_slot._offset") + (inside % F.col("_slot._each")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack(
    docs: DataFrame, tokenizer: str, keys: list[str] | None = None, window: int = WINDOW,
    end_id: int = 2, with_ids: bool = True,
) -> DataFrame:
    """All documents as placed pieces; see ``cut_pieces`` and ``place``."""
    return place(cut_pieces(docs, keys or ["doc_id"], tokenizer, window, end_id, with_ids), window)
