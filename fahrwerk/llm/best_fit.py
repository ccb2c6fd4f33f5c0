"""Best-fit packing of whole documents by patterns, counted by non-negative least squares.

Only documents longer than the window are cut, into pieces of a window.  The
plan is made from the histogram of piece lengths, which has at most as many
rows as the window has tokens, however large the corpus is:

1.  Patterns are all pairs and triples of lengths that occur and fill a window
    exactly.
2.  Their repeat counts x are fitted to the histogram h by non-negative least
    squares, ``min |A x - h|`` over ``x >= 0``, lengths weighted by their tokens.
    Block coordinate descent takes, in each sweep, the patterns that lower
    the error most and share no length, and moves each to its own minimum;
    counts that are too high come down again.
3.  Counts are rounded, and held to what remains of each length, the most
    used patterns first.
4.  What remains is packed by best fit in decreasing order of length: a piece
    goes to the sequence with the least room that still holds it.  Equal
    sequences are kept as one group with a count.

Each piece then finds its place from its rank among the pieces of its length.
Ranks are made without a task that sees all pieces of a length: pieces are
dealt into cells by a hash, cells and lengths are counted, and the counts
before a cell are added to the rank in it.

Null texts are empty: one piece with the end id alone.  Rows that repeat a
doc_id are packed as often as they occur, each with its own pieces; equal ones
may take each other's place.  No id is dropped or repeated.  Ties between
pieces of a length go by cell, doc_id and start.  An empty table gives an
empty result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize
from .packing import PIECE, VOCABULARY, _pieces

WINDOW = 4096
#: Least change of a count.
LEAST_STEP = 0.5
#: All patterns are looked at so often; the best so many, and those in use, then take sweeps until their gains are this part of the best one's.
LOOKS, LOOKED_AT, SWEEPS, PART_OF_BEST = 40, 16_384, 60, 0.02
#: Pieces of a cell on average, and least cells.
PIECES_PER_CELL, CELLS = 100_000, 256


def patterns(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows (a, b, c) of lengths that fill a window, in ascending order; a = 0 in pairs."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    present[[0, window]] = False
    have = np.flatnonzero(present)
    low = have[(have <= window // 2) & present[window - have]]
    found = [np.stack([np.zeros_like(low), low, window - low], axis=1)]
    for a in have[have <= window // 3].tolist():
        b = have[np.searchsorted(have, a) : np.searchsorted(have, (window - a) // 2, "right")]
        b = b[present[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found).astype(np.int32)


class Fit:
    """Repeat counts of patterns whose sum of lengths is nearest to a histogram (by length), none below 0."""

    def __init__(self, rows: np.ndarray, histogram: np.ndarray):
        self.rows, self.x = rows, np.zeros(len(rows))
        self.weight = np.arange(len(histogram)) / max(1, len(histogram) - 1)
        self.left = histogram.astype(np.float64)
        self.left[0] = 0
        a, b, c = rows.T
        weight = self.weight
        self.norm = weight[a] + weight[b] + weight[c] + 2 * (weight[a] * (a == b) + weight[b] * (b == c) + weight[a] * (a == c))

    def steps(self, which=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """How far each pattern is from its own minimum, and by how much the error would fall there."""
        pull, norm = self.weight * self.left, self.norm[which]
        a, b, c = self.rows[which].T
        step = np.maximum((pull[a] + pull[b] + pull[c]) / norm, -self.x[which])
        step[np.abs(step) < LEAST_STEP] = 0
        return step, step * step * norm

    def sweep(self, which: np.ndarray) -> float:
        """Moves the best of these patterns that share no length; returns the largest gain before."""
        step, gain = self.steps(which)
        top = float(gain.max(initial=0.0))
        if top:
            order = np.argsort(gain, kind="stable")
            order = order[gain[order] > 0]
            a, b, c = self.rows[which[order]].T
            # The best pattern of each length; a pattern moves if it is that for all its lengths.
            best, own = np.full(len(self.left), -1), np.arange(len(order))
            for column in (a, b, c):
                np.maximum.at(best, column, own)
            moved = (best[b] == own) & (best[c] == own) & ((best[a] == own) | (a == 0))
            which, step = which[order[moved]], step[order[moved]]
            self.x[which] += step
            for column in self.rows[which].T:
                np.subtract.at(self.left, column, step)
            self.left[0] = 0
        return top

    def run(self) -> np.ndarray:
        for _ in range(LOOKS):
            _, gain = self.steps()
            some = np.flatnonzero(gain)
            if not len(some):
                break
            if len(some) > LOOKED_AT:
                some = some[np.argpartition(gain[some], -LOOKED_AT)[-LOOKED_AT:]]
            top = float(gain[some].max())
            some = np.union1d(some, np.flatnonzero(self.x))
            for _ in range(SWEEPS):
                if self.sweep(some) <= PART_OF_BEST * top:
                    break
        return self.x


def best_fit(histogram: dict[int, int], window: int = WINDOW):
    """Yields (pattern of lengths with counts, times used): best fit in decreasing order of length."""
    # A group of equal sequences: [count, room, group that it grew from, length added, times].
    groups: list[list] = []
    by_room: dict[int, list[int]] = {}
    rooms = np.zeros(window + 1, bool)

    def put(count, room, base, length, times):
        groups.append([count, room, base, length, times])
        by_room.setdefault(room, []).append(len(groups) - 1)
        rooms[room] = True

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            open_rooms = np.flatnonzero(rooms[length:])
            if len(open_rooms):
                room = int(open_rooms[0]) + length
                g = by_room[room][-1]
                base = g
            else:
                room, g, base = window, None, None
            # A sequence takes this length as often as it fits.
            times = min(room // length, left)
            count = left // times if g is None else min(groups[g][0], left // times)
            if g is not None:
                groups[g][0] -= count
                if not groups[g][0]:
                    by_room[room].pop()
                    rooms[room] = bool(by_room[room])
            put(count, room - times * length, base, length, times)
            left -= count * times
    for count, _, base, length, times in groups:
        if count:
            pattern = {length: times}
            while base is not None:
                _, _, before, length, times = groups[base]
                pattern[length] = pattern.get(length, 0) + times
                base = before
            yield pattern, count


@dataclass
class Plan:
    """For runs of ranks of each length: from which rank on, how many a sequence takes, the first sequence and the offset there."""

    length: np.ndarray
    first: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by their length and rank."""
        at = np.searchsorted((self.length << 48) | self.first, (length << 48) | rank, "right") - 1
        turn, nth = np.divmod(rank - self.first[at], self.times[at])
        return self.sequence[at] + turn, self.offset[at] + nth * length


def plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """Where pieces of each length go, from how many there are."""
    counts = np.zeros(window + 1, np.int64)
    for n, k in histogram.items():
        counts[n] = k
    rows = patterns(np.array(sorted(histogram), np.int64), window)
    x = Fit(rows, np.where(np.arange(window + 1) < window, counts, 0)).run()
    left, used = counts.copy(), []
    support = np.flatnonzero(x >= LEAST_STEP)
    for j in support[np.argsort(-x[support], kind="stable")].tolist():
        pattern: dict[int, int] = {}
        for n in rows[j].tolist():
            if n:
                pattern[n] = pattern.get(n, 0) + 1
        times = min(int(x[j] + 0.5), *(int(left[n]) // m for n, m in pattern.items()))
        if times:
            used.append((pattern, times))
            for n, m in pattern.items():
                left[n] -= m * times
    used += best_fit({int(n): int(left[n]) for n in np.flatnonzero(left)}, window)
    runs, ranks, base = [], {}, 0
    for pattern, times in used:
        offset = 0
        for n in sorted(pattern, reverse=True):
            first = ranks.get(n, 0)
            runs.append((n, first, pattern[n], base, offset))
            ranks[n] = first + pattern[n] * times
            offset += n * pattern[n]
        base += times
    return Plan(*(np.array(c, np.int64) for c in (zip(*sorted(runs), strict=True) if runs else [[]] * 5)), base)


def _placed(plan: Plan, window: int):
    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            start = col["start"].to_numpy()
            sequence, offset = plan.place(col["length"].to_numpy(), col["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"], pa.array((start // window).astype(np.int32)), col["start"], col["length"], col["ids_crc32"], pa.array(sequence), pa.array(offset), col["doc_tokens"]],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens"],
            )

    return run


def ranked(pieces: DataFrame, cells: int) -> DataFrame:
    """``pieces`` with their rank (from 0) among the pieces of their length."""
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(cells)).cast("int"))
    counts = dealt.groupBy("cell", "length").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("cell", "length", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("cell", "length").orderBy("doc_id", "start", "ids_crc32"))
    return dealt.withColumn("inside", inside).join(counts, ["cell", "length"]).withColumn("rank", F.col("before") + F.col("inside") - 1)


def pack_whole(documents: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """One row per piece: its place in its document, its sequence and offset there."""
    pieces = materialize(documents.select("doc_id", "text").mapInArrow(_pieces(vocabulary, window), PIECE))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    made = plan(histogram, window)
    cells = max(CELLS, sum(histogram.values()) // PIECES_PER_CELL)
    rows = ranked(pieces, cells).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return rows.mapInArrow(_placed(made, window), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, doc_tokens long")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_whole(spark.read.parquet(f"{sf_dir}/documents.parquet"))
