"""Operator 8: best-fit packing by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small, table
from .tokens import token_ids

END_ID = 2


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[int]:
    """Lengths (with multiplicity) of a fullest combination of at most ``room``: bounded subset sum over bitsets.

    Bit ``s`` of a bitset says that some combination of the lengths seen so far sums to ``s``. The bitset after
    each length is kept to walk the combination back; the scan stops once the room can be filled exactly.
    """
    mask, bits = (1 << (room + 1)) - 1, 1
    trail: list[tuple[int, int]] = []
    for length in order:
        if length > room or not counts[length]:
            continue
        trail.append((length, bits))
        left, step = min(counts[length], room // length), 1
        while left:  # copies in powers of two
            step = min(step, left)
            bits |= (bits << (step * length)) & mask
            left, step = left - step, step * 2
        if bits >> room & 1:
            break
    at, chosen = bits.bit_length() - 1, []
    for length, before in reversed(trail):
        while not before >> at & 1:
            chosen.append(length)
            at -= length
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(multiplicity by length, number of bins)`` patterns that use up the histogram.

    Each bin takes the longest piece left and fills the rest as full as the lengths left allow. The combination
    is removed as often as the counts allow before the next search, so the work depends on the number of
    distinct lengths (at most ``capacity``), not on the number of pieces.
    """
    counts = {k: n for k, n in histogram.items() if n}
    order = sorted(counts, reverse=True)
    plan = []
    for length in order:
        while counts[length]:
            counts[length] -= 1
            chosen = [length, *fullest(counts, order, capacity - length)]
            counts[length] += 1
            pattern = {k: chosen.count(k) for k in chosen}
            times = min(counts[k] // c for k, c in pattern.items())
            for k, c in pattern.items():
                counts[k] -= c * times
            plan.append((pattern, times))
    return plan


def pieces(docs: DataFrame, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Token pieces of every row with the task they come from and their number there among pieces of their length."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    names = [id_col, "piece", "start", "length", "ids_crc32", "task", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(token_ids(text or ""), np.uint32(end_id)).astype("<u4").tobytes()
                n, start = len(ids) // 4, 0
                for k in range(-(-n // capacity)):
                    length = (n - 1) % capacity + 1 if k == 0 else capacity
                    for out, v in zip(rows, (ident, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]), strict=True):
                        out.append(v)
                    seen[length] += 1
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n in ("piece", "task") else pa.int64()) for n, x in zip(names, rows, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every row.

    A row's ids are its text's tokens and ``end_id``; null text counts as empty, so every row has a piece. Rows
    over ``capacity`` are cut into full pieces behind a shorter first one. Repeated rows and null ids are packed
    as they stand, ids being repeated; other columns are ignored. An empty table packs into nothing.

    Only the histogram of lengths (``capacity`` numbers) reaches the driver. A piece finds its place by its rank
    among the pieces of its length: its number in its task plus what earlier tasks hold of that length.
    """
    import numpy as np
    import pyarrow as pa

    cutout = cut(pieces(docs, capacity, end_id, id_col, text_col))
    held = cutout.groupBy("task", "length").agg(F.count("*").alias("n"))
    held = cut(held.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"), "n"))
    plan = plan_bins({r[0]: r[1] for r in held.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, times in plan:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            slots.setdefault(length, []).append((used.get(length, 0), copies, base, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
        base += times
    arrays = {k: np.array(v, dtype=np.int64).T for k, v in slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            length, rank = cols["length"].to_numpy(), cols["rank"].to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                at = length == k
                first, copies, start, offset = arrays[k]
                i = np.searchsorted(first, rank[at], side="right") - 1
                r = rank[at] - first[i]
                seq[at], off[at] = start[i] + r // copies[i], offset[i] + r % copies[i] * k
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(cols[n] for n in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    ranked = cutout.join(small(held.drop("n"), 24), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.select(id_col, "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"{id_col} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
