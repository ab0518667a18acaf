"""Packing by cutting stock with column generation.

Documents are tokenised and cut into pieces of at most the sequence length. Piece lengths are rounded up to 128 classes,
and the histogram of classes (128 numbers, whatever the corpus) is a cutting-stock problem: a linear program over
patterns of classes that fill a sequence. Starting from simple patterns, a knapsack by dynamic programming prices new ones with the program's duals until
none is worth its sequence by more than a tolerance. Patterns are used as often as the program says, rounded down; what
remains, no more than a few sequences per class, is packed best-fit. Pieces are ranked within their class, and a table
of (class, ranks) -> sequences places each piece on its own; within a sequence they follow one another without gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import blocks, inverted, record, small_batches, staged

#: Length classes; with many more the linear program takes minutes, with fewer rounding pads more.
CLASSES = 128
#: Pieces are ranked in so many groups by hash, so that a class that many pieces share isn't ranked in one task.
RANK_GROUPS = 512


class Encoder:
    """Token ids of a byte-level BPE as the ``tokenizers`` library gives them.

    ``json_path`` is that library's file; ``ranks_path`` the same vocabulary as ranks, from which ``tiktoken`` makes the
    same ids at a multiple of the speed. Texts with a special token's string, or over a million characters, and all
    texts when ``ranks_path`` is None, go to ``tokenizers``.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        import base64
        import json

        self.json_path, self._exact, self.fast = json_path, None, None
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @property
    def exact(self):
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.json_path)
        return self._exact

    def ids(self, text: str) -> list[int]:
        if self.fast is None or len(text) > 1_000_000 or any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def gain(prices: np.ndarray, lengths: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack: the most valuable pattern of ``lengths`` in ``room``, each used any number of times."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    useful = prices > 1e-12
    ls, ps, ids = lengths[useful], prices[useful], np.flatnonzero(useful)
    order = np.argsort(ls)
    ls, ps, ids = ls[order], ps[order], ids[order]
    for c in range(1, room + 1):
        k = np.searchsorted(ls, c, "right")
        best[c] = best[c - 1]
        if k:
            value = best[c - ls[:k]] + ps[:k]
            j = int(value.argmax())
            if value[j] > best[c] + 1e-15:
                best[c], last[c] = value[j], j
    pattern, c = np.zeros(len(lengths), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[ids[last[c]]] += 1
            c -= ls[last[c]]
    return float(best[room]), pattern


def generate(lengths: np.ndarray, demand: np.ndarray, room: int, tolerance: float = 2e-4, most: int = 6000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their use in the linear program ``min sum x, sum a x = demand`` (revised simplex).

    Stops when the bound ``value / best price`` is within ``tolerance`` of the value, or after ``most`` columns, each of
    which leaves a feasible solution.
    """
    m = len(lengths)
    columns = [np.eye(m, dtype=np.int64)[i] * (room // lengths[i]) for i in range(m)]
    inverse = np.diag(1.0 / (room // lengths))
    x = demand / (room // lengths)
    for step in range(most):
        if step % 500 == 499:
            inverse = inverted(np.array(columns).T)
            x = np.maximum((inverse * demand).sum(axis=1), 0)
        prices = inverse.sum(axis=0)
        value, pattern = gain(np.maximum(prices, 0), lengths, room)
        if value <= 1 + tolerance:
            break
        u = (inverse * pattern).sum(axis=1)
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        theta = ratio[r]
        x = np.maximum(x - theta * u, 0)
        x[r] = theta
        row = inverse[r] / u[r]
        inverse -= np.outer(u, row)
        inverse[r] = row
        columns[r] = pattern
    return list(zip(columns, x.tolist(), strict=True))


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: times}, uses) that pack the histogram exactly."""
    left = {n: k for n, k in histogram.items() if k}
    uses: list[tuple[dict[int, int], int]] = []
    if room in left:
        uses.append(({room: 1}, left.pop(room)))
    if left:
        lengths = np.array(sorted(left))
        for pattern, x in generate(lengths, np.array([left[n] for n in lengths.tolist()], float), room):
            p = {int(lengths[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}
            if k := min([int(x + 1e-6), *(left[n] // a for n, a in p.items())]):
                uses.append((p, k))
                for n, a in p.items():
                    left[n] -= k * a
    open_: list[list] = []  # of the rest: [room left, pattern]; best fit, longest first
    by_room: dict[int, list[int]] = {}
    for n in sorted((n for n, k in left.items() if k), reverse=True):
        for _ in range(left[n]):
            fit = next((r for r in range(n, room + 1) if by_room.get(r)), None)
            if fit is None:
                open_.append([room, {}])
                i = len(open_) - 1
            else:
                i = by_room[fit].pop()
            open_[i][0] -= n
            open_[i][1][n] = open_[i][1].get(n, 0) + 1
            by_room.setdefault(open_[i][0], []).append(i)
    return uses + [(p, 1) for _, p in open_]


def placement(uses: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each class, rows ``first rank, first sequence, times, slot`` in order of rank."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, k in uses:
        slot = 0
        for n in sorted(pattern, reverse=True):
            at = ranks.get(n, 0)
            table.setdefault(n, []).append((at, sequence, pattern[n], slot))
            ranks[n] = at + k * pattern[n]
            slot += pattern[n]
        sequence += k
    return {n: np.array(rows, np.int64) for n, rows in table.items()}


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("row", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _cutter(encoder_args: tuple, room: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*encoder_args)
        fields = PIECES if with_ids else pa.schema(list(PIECES)[:-1])
        for b in blocks(batches, "text"):
            rows = []
            for doc, text, row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "row")), strict=True):
                ids = np.array([*encoder.ids(text or ""), 0], "<u4")
                raw = memoryview(ids).cast("B")
                for at in range(0, len(ids), room):
                    n = min(room, len(ids) - at)
                    rows.append((doc, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(ids), row, ids[at : at + n].tolist() if with_ids else None)[: len(fields)])
            yield record(fields, *(list(c) for c in zip(*rows, strict=True)))

    return cut


def _placer(table: dict[int, np.ndarray]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, rank = b.column("class").to_numpy(), b.column("rank").to_numpy()
            sequence, slot = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(kind):
                own = np.flatnonzero(kind == n)
                rows = table[int(n)]
                rows = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                nth = rank[own] - rows[:, 0]
                sequence[own] = rows[:, 1] + nth // rows[:, 2]
                slot[own] = rows[:, 3] + nth % rows[:, 2]
            keep = [c for c in b.schema.names if c not in ("rank", "class")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(slot)], names=[*keep, "sequence_id", "slot"])

    return place


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, room: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Null or empty text is one piece with id 0 alone; documents of over ``room`` ids are cut every ``room`` ids; rows that
    repeat are packed as often; null ids are packed; no rows give no pieces; further columns are ignored. Sequences are
    numbered from 0; pieces lie in them without gaps.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long" + ", ids array<int>" * with_ids
    cut = text.mapInArrow(_cutter((json_path, ranks_path, pattern), room, with_ids), fields)
    unit = max(1, room // CLASSES)
    kind = F.least(F.lit(room // unit), F.ceil(F.col("length") / unit)).cast("int")
    pieces = staged(cut.withColumn("class", kind).withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(RANK_GROUPS)).cast("int")))
    groups = staged(pieces.groupBy("class", "part").count())
    histogram = {r["class"]: r["n"] for r in groups.groupBy("class").agg(F.sum("count").alias("n")).collect()}  # at most CLASSES rows
    table = placement(plan(histogram, room // unit))
    starts = groups.withColumn("first", F.coalesce(F.sum("count").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("class", "part").orderBy("row", "start")) - 1
    ranked = pieces.join(starts, ["class", "part"]).withColumn("rank", rank + F.col("first"))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in out.split(", ")]
    placed = ranked.select(*names, "class", "rank").mapInArrow(_placer(table), out + ", sequence_id long, slot long")
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(before, F.lit(0))).drop("slot")
