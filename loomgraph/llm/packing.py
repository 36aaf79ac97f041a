"""Best-fit packing of token pieces by patterns of few documents.

The lengths' histogram decides everything, so only it (one row for each possible length) goes to the
driver.  Patterns of up to four lengths that fill a sequence are enumerated on a grid of ``GRID`` steps,
those of four on one of 32 steps; non-negative least squares fits how often each is repeated; the counts are rounded and drawn as far as lengths are left
that fill a sequence exactly; the rest goes to the smallest gap that holds it, longest first.  The plan says which ranks of a length
go where.  Ranks are counted in blocks of a length and a partition, so no length is one task's.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.scratch import Scratch
from loomgraph.llm.tokens import word_tokenizer

#: Lengths are rounded up to this many steps of the capacity when patterns are enumerated.
GRID = 128
#: Documents in a pattern at most.
PATTERN_DOCUMENTS = 4
#: Sequences that share one list of lengths, and how many there are.
Strategy = tuple[tuple[int, ...], int]


def patterns(grid: int = GRID, most: int = PATTERN_DOCUMENTS) -> np.ndarray:
    """All multisets of 1 to ``most`` grid lengths with sum ``grid``, as rows padded with 0."""
    rows = []
    for size in range(1, most + 1):
        if size < 4:
            rows += [(*c, grid - sum(c)) for c in combinations_with_replacement(range(1, grid // size + 1), size - 1) if grid - sum(c) >= max(c, default=1)]
        else:  # the longest pattern on a coarser grid: its number grows with a power of the grid
            step = max(1, grid // 32)
            coarse = [(*c, grid // step - sum(c)) for c in combinations_with_replacement(range(1, grid // step // size + 2), size - 1)]
            rows += [tuple(step * x for x in c) for c in coarse if c[-1] >= c[-2]]
    return np.array([(*r, *[0] * (most - len(r))) for r in sorted(set(rows))], np.int64)


def fit(chosen: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |W(Ax - target)|, by the active-set method in at most ``steps`` steps.

    The steps bound the search, not what is packed: what no count covers is packed as a residual.
    ``chosen`` holds the patterns; column j of A counts how often each length is in pattern j.
    """
    size, length = len(chosen), len(target)
    x, passive = np.zeros(size), np.zeros(size, bool)
    scale = target.max() or 1.0
    goal = target / scale
    used = chosen > 0

    def matrix(columns: np.ndarray) -> np.ndarray:
        a = np.zeros((length, len(columns)))
        for k in range(chosen.shape[1]):
            on = used[columns, k]
            np.add.at(a, (chosen[columns[on], k], np.flatnonzero(on)), 1.0)
        return a

    for _ in range(steps):
        columns = np.flatnonzero(passive)
        rest = weight**2 * (goal - (matrix(columns) @ x[columns] if len(columns) else 0.0))
        gain = np.where(used, rest[chosen], 0.0).sum(axis=1)
        gain[passive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9:
            break
        passive[best] = True
        while True:
            columns = np.flatnonzero(passive)
            solved = np.linalg.lstsq(matrix(columns) * weight[:, None], goal * weight, rcond=None)[0]
            if solved.min() > 0:
                x[:] = 0
                x[columns] = solved
                break
            low = solved <= 0
            share = np.min(x[columns][low] / np.maximum(x[columns][low] - solved[low], 1e-15))
            x[columns] += share * (solved - x[columns])
            gone = columns[(x[columns] <= 1e-12) & low]
            if not len(gone):
                gone = columns[low]
            x[gone], passive[gone] = 0, False
    return x * scale


def pack_histogram(histogram: dict[int, int], capacity: int, grid: int = GRID) -> list[Strategy]:
    """Strategies that together hold every item of the histogram (length -> count) exactly once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be between 1 and the capacity")
    strategies: list[Strategy] = [((capacity,), left.pop(capacity))] if capacity in left else []
    strategies += _by_patterns(left, capacity, grid)
    return _residuals(left, strategies, capacity)


def _by_patterns(left: dict[int, int], capacity: int, grid: int) -> list[Strategy]:
    """The fitted patterns; takes what they use out of ``left``."""
    grid = min(grid, capacity)
    step = -(-capacity // grid)
    grid = capacity // step  # so that full patterns never exceed the capacity
    boxes: list[list[int]] = [[] for _ in range(grid + 1)]
    for n in sorted(left):
        if -(-n // step) <= grid:
            boxes[-(-n // step)].append(n)
    target = np.array([sum(left[n] for n in box) for box in boxes], float)
    if grid < 4 or not target.any():
        return []
    chosen = patterns(grid)
    chosen = chosen[np.where(chosen > 0, target[chosen] > 0, True).all(axis=1)]
    if not len(chosen):
        return []
    weight = np.where(np.arange(grid + 1) * 16 < grid, 0.2, 1.0)  # short ones also fit into gaps
    repeats = np.rint(fit(chosen, target, weight)).astype(np.int64)
    found: list[Strategy] = []
    for j in np.argsort(-repeats, kind="stable"):
        todo, slots = int(repeats[j]), [int(b) for b in chosen[j] if b]
        for drawn in product(*(reversed(boxes[b]) for b in slots[:-1])):
            if todo <= 0:
                break
            # grid lengths are rounded up: the last slot takes the length that fills the sequence
            taken = Counter((*drawn, capacity - sum(drawn)))
            times = min(todo, *(left.get(n, 0) // k for n, k in taken.items()))
            if times > 0:
                for n, k in taken.items():
                    left[n] -= k * times
                    if not left[n]:
                        del left[n]
                found.append((tuple(sorted(taken.elements(), reverse=True)), times))
                todo -= times
    return found


def _residuals(left: dict[int, int], strategies: list[Strategy], capacity: int) -> list[Strategy]:
    """The rest by best fit, longest first, many equal sequences at a time."""
    done: list[Strategy] = []
    open_: dict[int, list[Strategy]] = {}
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], count: int) -> None:
        gap = capacity - sum(lengths)
        if not gap:
            done.append((lengths, count))
            return
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((lengths, count))

    for lengths, count in strategies:
        put(lengths, count)
    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                if todo >= each:
                    put((n,) * each, todo // each)
                if todo % each:
                    put((n,) * (todo % each), 1)
                break
            gap = gaps[at]
            lengths, count = open_[gap].pop()
            if not open_[gap]:
                del open_[gap], gaps[at]
            each = min(gap // n, todo)
            times = min(count, todo // each)
            if times < count:
                put(lengths, count - times)
            put(lengths + (n,) * each, times)
            todo -= each * times
    return done + [s for gap in gaps for s in open_[gap]]


def placements(strategies: list[Strategy]) -> tuple[np.ndarray, ...]:
    """(length, first rank, first sequence, offset) of each run of ranks, sorted by length and rank."""
    rows, ranks, base = [], {}, 0
    for lengths, count in strategies:
        offset = 0
        for n in lengths:
            rows.append((n, ranks.get(n, 0), base, offset))
            ranks[n] = ranks.get(n, 0) + count
            offset += n
        base += count
    rows.sort()
    return tuple(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 4))


def _pieces(path: str, capacity: int, end_id: int | None, keep_ids: bool):
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = word_tokenizer(path).encode
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def tokenize_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, then ``end_id``, cut into pieces of at most ``capacity`` ids.

    Columns doc_id, piece, start, length, ids_crc32 and ids (little-endian unsigned 32-bit, null
    unless ``keep_ids``).  A null text is empty; without an ``end_id`` an empty text has no piece.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id, keep_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def assign_sequences(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length, any others) with sequence_id and offset.

    Sequences are filled without gaps from offset 0 and hold at most ``capacity``.  Rows without a
    length are left out; repeated rows and null ids are items of their own; an empty table gives an
    empty result.  A column of ``pieces`` named like one of the new ones is replaced; _part, _rank and
    _first are names of its own and dropped.  To the driver and with each task go a row for each length
    and the plan's runs of ranks, both bounded by the capacity's square and not by the rows.
    """
    scratch = Scratch(pieces.sparkSession, "pack")
    kept = pieces.drop("sequence_id", "offset", "_part", "_rank", "_first").where("length IS NOT NULL")
    kept = scratch.write("pieces", kept.withColumn("_part", F.spark_partition_id()))
    counts = kept.groupBy("length", "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = scratch.write("first", counts.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0))))
    histogram = {r["length"]: r["_rows"] for r in first.groupBy("length").agg(F.sum("_rows").alias("_rows")).collect()}  # a row for each length
    length, rank, sequence, offset = placements(pack_histogram(histogram, capacity))
    width = np.int64(1 << 44)
    keys = length * width + rank

    names = [c for c in kept.columns if c != "_part"]
    plain = [f"c{i}" for i in range(len(names))]  # whatever characters the names have

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_length = names.index("length")
        for batch in batches:
            n, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at_length, len(names)))
            at = np.searchsorted(keys, n * width + r, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])], [*plain, "sequence_id", "offset"])

    order = Window.partitionBy("length", "_part").orderBy(*[c for c in ("doc_id", "piece", "ids_crc32") if c in names])
    ranked = kept.withColumn("_rank", F.row_number().over(order) - 1).join(first.select("length", "_part", "_first"), ["length", "_part"])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in names], (F.col("_rank") + F.col("_first")).alias("_rank")).toDF(*plain, "_rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema[:-1])
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long").toDF(*names, "sequence_id", "offset")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole documents in few sequences: ``tokenize_pieces`` followed by ``assign_sequences``."""
    pieces = tokenize_pieces(documents, tokenizer_path, capacity, end_id, keep_ids, id_col, text_col)
    return assign_sequences(pieces if keep_ids else pieces.drop("ids"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, from pieces that were packed with their ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, CAST('' AS BINARY), (a, p) -> a || p.ids)").alias("ids"))
