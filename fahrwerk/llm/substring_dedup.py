"""Fuzzy substring dedup by collinear chaining.

Words are runs of anything but spaces and bytes 9 to 13, A-Z taken as a-z.
Seeds are k-mers of K words, winnowed: every window of W k-mers keeps its
smallest, so that a common run of K + W - 1 words shares a seed.  Each seed
is matched with one earlier occurrence, never with all others: a passage in n
documents gives n - 1 matches.  Within a slice of texts (a few megabytes)
that is the occurrence with the smallest doc_id, then position; these alone
are sent on, and meet the smallest of all, so that a seed that very many
documents hold comes to one place once for each slice.

A document's matches with an earlier one are chained in order of both
positions; where the order conflicts, a Fenwick tree over positions finds the
best chain with gap costs.  Chains are cut at gaps above GAP words beyond a
seed.  What a document's chains can reach at most, REACH words beyond both
ends, must be LEAST words together, or they are dropped.  Between seeds that
are at the same distance of at most K words in both documents, words are
equal; all other gaps and ends are aligned by longest common subsequence.
The words of earlier documents are fetched in blocks of FETCH words, each
block once, whoever asks for it.  An end reaches as far as the words matched
exceed those missed by most.  Of a chain, all longest stretches with at least
IDENTITY of their words matched remain, so that filler beside a passage
doesn't count against it; as a passage's seeds may first occur in different
documents, parts that touch count as one passage, which must have at least
LEAST words, half of them in one part (short lines that many documents hold
don't make a passage where they happen to follow each other).

Null and empty texts have no words; an empty table gives an empty result.
Rows that repeat a doc_id and its text are one document; of different texts
with one doc_id the one with the least digest has its place among the others,
further ones count as later than all doc_ids, each a document of its own that
loses its own passages only.  Rows without doc_id take no part.  Of equal texts the
smallest doc_id is the earlier one.  Very long texts are read whole.  Repeats
inside one document are not reported.  Columns beyond doc_id and text are not
read; ``drop_repeats`` keeps them, whatever their names.  Where slices lie
decides with which earlier document a passage is reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import free_names, materialize, release

K = 5
W = 5
GAP = 30
REACH = 2 * (K + W)  # an edit, and the words beyond it that may hold no seed
LEAST = 50
IDENTITY = 0.8
SEED_WEIGHT = 5.0
GAP_COST = 0.1
#: Ids of documents are broadcast up to this number; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Spans to cut, and documents that have some, are broadcast (8 bytes each) up to this number; beyond it texts are shuffled once more.
BROADCAST_SPANS = 500_000
#: Documents, each with all it needs of earlier ones, that a task hands to Python at once.
DOCS_AT_ONCE = 200
#: Rows with the seeds of a slice in a bucket, or documents with their matches, that it does.
LOADS_AT_ONCE = 100
#: Words of a block of an earlier document.
FETCH = 64
#: Bytes of the texts of a slice, and documents whose seeds meet in a bucket on average.
SLICE = 1_000_000
DOCS_PER_BUCKET = 10_000


def winnow(buf: np.ndarray, off: np.ndarray, k: int = K, w: int = W):
    """(text, word position, hash) of the seeds of texts."""
    starts, ends, first = tv.bounds(buf, off)
    words = tv.word_hashes(buf, starts, ends)
    runs = tv.grams(words, k)
    count = np.maximum(np.diff(first) - k + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    h = runs[first[:-1][doc] + at]
    # Texts lie apart by w - 1 empty places, so that no window reaches from one into another.
    spot = np.arange(total) + doc * (w - 1)
    line = np.full(total + len(count) * (w - 1) + w, np.iinfo(np.uint64).max, np.uint64)
    line[spot] = h
    n = len(line) - w + 1
    low = line[:n].copy()
    for j in range(1, w):
        np.minimum(low, line[j : j + n], out=low)
    window = spot[at <= np.maximum(count[doc] - w, 0)]
    picked = np.zeros(len(line), bool)
    for j in range(w):
        picked[window + j] |= line[window + j] == low[window]
    # Of a run of equal k-mers (one word again and again) every w-th is enough.
    new = np.ones(total, bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    place = np.arange(total)
    keep = picked[spot] & ((place - np.maximum.accumulate(np.where(new, place, 0))) % w == 0)
    return doc[keep], at[keep], h[keep]


#: Rows that tasks send: the seeds of a slice in a bucket, or (without hashes) matches inside a slice.
_SENT = "bucket int, h binary, doc binary, place binary, first binary, spot binary"


def _sent(buckets: int):
    """Seeds that no earlier document of the slice holds, dealt into buckets, and the others as matches."""

    def run(batches):
        turn = 0
        for ids, texts in tv.rows(batches, ["doc_id", "text"]):
            ids = ids.to_numpy(zero_copy_only=False)
            for i, buf, off in tv.slices(texts, SLICE):
                doc, at, h = winnow(buf, off)
                doc = ids[i + doc].astype(np.int64)
                order = np.lexsort((at, doc, h))
                h, doc, at = h[order], doc[order], at[order].astype(np.int32)
                new = np.diff(h, prepend=h[:1] ^ np.uint64(1)) != 0
                group = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
                met = doc != doc[group]
                yield pa.RecordBatch.from_arrays([pa.array([turn % buckets], pa.int32()), pa.nulls(1, pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in (doc[met], at[met], doc[group[met]], at[group[met]]))], ["bucket", "h", "doc", "place", "first", "spot"])
                turn += 1
                h, doc, at = h[~met], doc[~met], at[~met]
                bucket = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                h, doc, at, bucket = h[order], doc[order], at[order], bucket[order]
                edge = np.flatnonzero(np.diff(bucket, prepend=-1))
                parts = list(zip(edge.tolist(), [*edge[1:].tolist(), len(h)], strict=True)) if len(h) else []
                cols = [pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (h, doc, at)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge], pa.int32()), *cols, pa.nulls(len(parts), pa.binary()), pa.nulls(len(parts), pa.binary())], ["bucket", "h", "doc", "place", "first", "spot"])

    return run


_MATCH = "b long, a long, p int, q int"


def _matches(b, a, p, q):
    for i in range(0, len(b), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(b[s], pa.int64()), pa.array(a[s], pa.int64()), pa.array(p[s], pa.int32()), pa.array(q[s], pa.int32())], ["b", "a", "p", "q"])


def _met(batches):
    """(document, earlier document, position there, position) of each seed that meets an earlier one."""
    waiting: dict[int, list] = {}
    for bucket, *columns in tv.rows(batches, ["bucket", "h", "doc", "place", "first", "spot"]):
        for k, row in zip(bucket.to_pylist(), zip(*(c.to_pylist() for c in columns), strict=True), strict=True):
            h, doc, at, first, spot = row
            if h is None:
                yield from _matches(np.frombuffer(doc, np.int64), np.frombuffer(first, np.int64), np.frombuffer(spot, np.int32), np.frombuffer(at, np.int32))
            else:
                waiting.setdefault(k, []).append((h, doc, at))
    while waiting:
        _, parts = waiting.popitem()
        h, doc, at = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*parts, strict=True), (np.uint64, np.int64, np.int32), strict=True))
        order = np.lexsort((at, doc, h))
        h, doc, at = h[order], doc[order], at[order]
        new = np.diff(h, prepend=h[:1] ^ np.uint64(1)) != 0
        group = np.flatnonzero(new)[np.cumsum(new) - 1]
        met = doc != doc[group]
        yield from _matches(doc[met], doc[group[met]], at[group[met]], at[met])
    tv.give_back()


class Fenwick:
    """Largest value at positions below a bound, with who holds it."""

    def __init__(self, n: int):
        self.value, self.who = [-1e300] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.value):
            if value > self.value[i]:
                self.value[i], self.who[i] = value, who
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        """Over positions below ``i``."""
        value, who = -1e300, -1
        while i:
            if self.value[i] > value:
                value, who = self.value[i], self.who[i]
            i -= i & -i
        return value, who


def chains(a: np.ndarray, b: np.ndarray, gap: int = GAP) -> list[np.ndarray]:
    """Chains of matches (indices), in order of both positions, cut at gaps."""
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    if len(a) < 2 or (np.all(a[1:] > a[:-1]) and np.all(b[1:] > b[:-1])):
        found = [np.arange(len(a))]
    else:
        rank = np.searchsorted(np.unique(a), a).tolist()
        tree = Fenwick(max(rank) + 1)
        score, back = [0.0] * len(a), [-1] * len(a)
        fa, fb = a.tolist(), b.tolist()
        waiting: list[int] = []
        for i in range(len(fa)):
            if waiting and fb[waiting[0]] < fb[i]:
                for j in waiting:
                    tree.put(rank[j], score[j] + GAP_COST * (fa[j] + fb[j]), j)
                waiting = []
            value, j = tree.best(rank[i])
            gain = value - GAP_COST * (fa[i] + fb[i])
            score[i] = SEED_WEIGHT + max(gain, 0.0)
            back[i] = j if gain > 0 else -1
            waiting.append(i)
        used, found = [False] * len(fa), []
        for i in sorted(range(len(fa)), key=lambda x: -score[x]):
            chain = []
            while i >= 0 and not used[i]:
                used[i] = True
                chain.append(i)
                i = back[i]
            if chain:
                found.append(np.array(chain[::-1]))
    out = []
    for c in found:
        cut = np.flatnonzero((np.diff(a[c]) > gap + K) | (np.diff(b[c]) > gap + K)) + 1
        out += [order[part] for part in np.split(c, cut)]
    return out


_CHAINS = "b long, a array<long>, size array<int>, p binary, q binary"


def _chained(least: int):
    """For each document the chains with earlier ones that may be part of a passage: seeds of all chains one after the other."""

    def run(batches):
        for docs, matches in tv.rows(batches, ["b", "matches"]):
            out = []
            for b, m in zip(docs.to_pylist(), matches, strict=True):
                a, p, q = (m.values.field(f).to_numpy() for f in ("a", "p", "q"))
                order = np.argsort(a, kind="stable")
                a, p, q = a[order], p[order], q[order]
                edge = np.flatnonzero(np.diff(a, prepend=a[:1] - 1))
                found = []
                for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(a)], strict=True):
                    x, y = p[i:j].astype(np.int64), q[i:j].astype(np.int64)
                    found += [(int(y[c[0]]), int(y[c[-1]]) + K, int(a[i]), x[c], y[c]) for c in chains(x, y)]
                found.sort(key=lambda c: (c[0], c[1], c[2], int(c[3][0])))
                # Chains whose reaches touch are together as long as a passage, or go.
                kept, run_, start, end = [], [], 0, -1
                for c in [*found, None]:
                    if run_ and (c is None or c[0] - REACH > end):
                        if end - max(0, start) >= least:
                            kept += run_
                        run_ = []
                    if c is not None:
                        start, end = (min(start, c[0] - REACH), max(end, c[1] + REACH)) if run_ else (c[0] - REACH, c[1] + REACH)
                        run_.append(c)
                if kept:
                    out.append((b, [c[2] for c in kept], [len(c[3]) for c in kept], np.concatenate([c[3] for c in kept]).astype(np.int32).tobytes(), np.concatenate([c[4] for c in kept]).astype(np.int32).tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(5)]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["b", "a", "size", "p", "q"])

    return run


def _spans(size: list[int], points: np.ndarray) -> list[tuple[int, int]]:
    """First and last seed of each chain."""
    edge = np.cumsum([0, *size])
    return list(zip(points[edge[:-1]].tolist(), points[edge[1:] - 1].tolist(), strict=True))


def _asked(batches):
    """(document, earlier document, block of its words) that chains need."""
    for docs, a, size, p in tv.rows(batches, ["b", "a", "size", "p"]):
        out = set()
        for b, firsts, sizes, raw in zip(docs.to_pylist(), a.to_pylist(), size.to_pylist(), p.to_pylist(), strict=True):
            for first, (lo, hi) in zip(firsts, _spans(sizes, np.frombuffer(raw, np.int32)), strict=True):
                out.update((b, first, k) for k in range(max(0, lo - REACH) // FETCH, (hi + K + REACH) // FETCH + 1))
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["b", "a", "block"])


def _fetched(batches):
    """The word hashes of each block that is asked for."""
    for a, texts, blocks in tv.rows(batches, ["a", "text", "blocks"]):
        for i, buf, off in tv.slices(texts):
            starts, ends, first = tv.bounds(buf, off)
            words = tv.word_hashes(buf, starts, ends)
            out = []
            for k in range(len(off) - 1):
                own = words[first[k] : first[k + 1]]
                out += [(a[i + k].as_py(), n, part.tobytes()) for n in blocks[i + k].as_py() if len(part := own[n * FETCH : (n + 1) * FETCH])]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["a", "block", "words"])


def common_words(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, by one bit per word of ``x``."""
    if not x or not y:
        return 0
    spots: dict[int, int] = {}
    for i, w in enumerate(x):
        spots[w] = spots.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for w in y:
        hit = row & spots.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def _same(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def reached(x: list[int], y: list[int]) -> tuple[int, int, int]:
    """(words of x, words of y, common words) of the beginnings whose common words exceed the others by most; ends with common ones."""
    if set(x).isdisjoint(y):
        return 0, 0, 0
    spots: dict[int, int] = {}
    for i, w in enumerate(x):
        spots[w] = spots.get(w, 0) | 1 << i
    row = full = (1 << len(x)) - 1
    best, n, met = 0, 0, 0
    for k in range(max(len(x), len(y))):
        if k < len(y):
            hit = row & spots.get(y[k], 0)
            row = ((row + hit) | (row - hit)) & full
        low = min(k + 1, len(x))
        common = low - (row & ((1 << low) - 1)).bit_count()
        if 2 * common - k - 1 > best:
            best, n, met = 2 * common - k - 1, k + 1, common
    i, j = min(n, len(x)), min(n, len(y))
    while i and common_words(x[: i - 1], y[:j]) == met:
        i -= 1
    while j and common_words(x[:i], y[: j - 1]) == met:
        j -= 1
    return i, j, met


def stretches(parts: list[tuple[int, int, int, bool, bool]], identity: float) -> list[tuple[int, int, float]]:
    """(first part, last part, share) of all longest stretches with enough words matched.

    A part has its words in both documents, those matched, and whether a
    stretch may start or end with it.  None of the stretches lies inside
    another; any stretch with enough words matched lies inside one.
    """
    a, b, met = (np.cumsum([0, *(p[i] for p in parts)]) for i in range(3))
    share = lambda i, j: (met[j] - met[i]) / np.maximum(a[j] - a[i], b[j] - b[i])
    first, last = (np.flatnonzero([p[i] for p in parts]) for i in (3, 4))
    out, top = [], -1
    for i in first.tolist():
        if top == last[-1]:
            break
        ends = last[np.searchsorted(last, max(i, top + 1)) :]
        good = ends[share(i, ends + 1) >= identity]
        if len(good):
            top = int(good[-1])
            out.append((i, top, float(share(i, top + 1))))
    return out


def _parts(segments: list[int], gaps: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[int, int, int, bool, bool]], int, int]:
    """The parts of a chain for ``stretches``: segments of equal words, what lies near them beyond edits, and what remains of the gaps.

    The first and the last gap lie beyond the ends.  Also the words of both
    documents by which the parts begin before the first segment.
    """
    segments, rest = [0, *segments, 0], []
    for k, (g, h) in enumerate(gaps):
        # Segment k lies before gap k, and k + 1 after it; the outermost don't exist.
        left = _same(g, h) if k else 0
        g, h = g[left:], h[left:]
        right = _same(g[::-1], h[::-1]) if k + 1 < len(gaps) else 0
        if not k:
            outer = right
        segments[k] += left
        segments[k + 1] += right
        g, h = g[: len(g) - right].tolist(), h[: len(h) - right].tolist()
        common = common_words(g, h)
        after = reached(g, h) if k else (0, 0, 0)
        g, h = g[after[0] :], h[after[1] :]
        before = reached(g[::-1], h[::-1]) if k + 1 < len(gaps) else (0, 0, 0)
        g, h = g[: len(g) - before[0]], h[: len(h) - before[1]]
        rest.append([(*after, False, True), (len(g), len(h), common - after[2] - before[2], False, False), (*before, True, False)])
    ahead = rest[0][2]
    parts = [ahead]
    for n, gap in zip(segments[1:-1], rest[1:], strict=True):
        parts += [(n, n, n, True, True), *gap]
    return [p for p in parts[:-2] if any(p[:3])], outer + ahead[0], outer + ahead[1]


def _aligned_chain(own: np.ndarray, other: np.ndarray, shift: int, p: np.ndarray, q: np.ndarray, identity: float):
    """(start, end, start in the other, end there, share) of the stretches of a chain; ``other`` begins ``shift`` words into its document."""
    # Between seeds, words to align; beyond both ends, as far as the reach.
    step = np.diff(p)
    g = np.flatnonzero((step != np.diff(q)) | (step > K))
    # A gap may hold fewer words in one document than seeds overlap in it: keep it from being negative.
    over = np.maximum(np.maximum(p[g] + K - p[g + 1], q[g] + K - q[g + 1]), 0)
    p0, p1 = [*(p[g] + K - over).tolist(), int(p[-1]) + K], [int(p[0]), *p[g + 1].tolist()]
    q0, q1 = [*(q[g] + K - over).tolist(), int(q[-1]) + K], [int(q[0]), *q[g + 1].tolist()]
    # Gap k lies between the end of segment k - 1 and the start of segment k.
    cut = lambda x, i, j, z: x[max(i - z, 0) : max(j - z, 0)]
    starts, ends = [(max(0, p1[0] - REACH), max(0, q1[0] - REACH)), *zip(p0, q0, strict=True)], [*zip(p1, q1, strict=True), (p0[-1] + REACH, q0[-1] + REACH)]
    gaps = [(cut(other, i, k, shift), cut(own, j, n, 0)) for (i, j), (k, n) in zip(starts, ends, strict=True)]
    parts, before_p, before_q = _parts([e - b for b, e in zip(p1, p0, strict=True)], gaps)
    at_p, at_q = (np.cumsum([z, *(part[k] for part in parts)]).tolist() for k, z in ((0, p1[0] - before_p), (1, q1[0] - before_q)))
    return [(at_q[i], at_q[j + 1], at_p[i], at_p[j + 1], round(share, 6)) for i, j, share in stretches(parts, identity)]


def _aligned(least: int, identity: float):
    """The passages of each document, whose parts touch and have enough words together."""

    def run(batches):
        for b, texts, a, size, p, q, fetched in tv.rows(batches, ["b", "text", "a", "size", "p", "q", "fetched"]):
            out = []
            for i, buf, off in tv.slices(texts):
                starts, ends, first = tv.bounds(buf, off)
                words = tv.word_hashes(buf, starts, ends)
                for k in range(len(off) - 1):
                    own, doc = words[first[k] : first[k + 1]], b[i + k].as_py()
                    held = {(x["a"], x["block"]): np.frombuffer(x["words"], np.uint64) for x in fetched[i + k].as_py()}
                    sizes = size[i + k].as_py()
                    edge = np.cumsum([0, *sizes]).tolist()
                    ps, qs = (np.frombuffer(c[i + k].as_py(), np.int32).astype(np.int64) for c in (p, q))
                    found = set()
                    for n, other in enumerate(a[i + k].as_py()):
                        x, y = ps[edge[n] : edge[n + 1]], qs[edge[n] : edge[n + 1]]
                        low = max(0, int(x[0]) - REACH) // FETCH
                        parts = [held.get((other, z)) for z in range(low, (int(x[-1]) + K + REACH) // FETCH + 1)]
                        there = np.concatenate([z for z in parts if z is not None] or [np.zeros(0, np.uint64)])
                        if y[-1] + K <= len(own) and x[-1] + K - low * FETCH <= len(there):
                            found.update((s0, s1, other, f0, f1, share) for s0, s1, f0, f1, share in _aligned_chain(own, there, low * FETCH, x, y, identity))
                    group, end = [], -1
                    for row in [*sorted(found), None]:
                        if group and (row is None or row[0] > end):
                            if end - group[0][0] >= least and 2 * max(r[1] - r[0] for r in group) >= least:
                                out += [(doc, r[2], r[0], r[1], r[3], r[4], r[1] - r[0], r[5]) for r in group]
                            group, end = [], -1
                        if row is not None:
                            group.append(row)
                            end = max(end, row[1])
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(8)]
            types = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in PASSAGE.split(", ")])

    return run


PASSAGE = "doc_id long, first_doc_id long, start int, end int, first_start int, first_end int, n_words int, identity double"


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (one column, distinct)."""
    near = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.join(near, "doc_id", "left_semi")


#: Keys of further texts of a doc_id lie in so wide a range beyond all doc_ids.
KEYS = 1 << 61


def _several(documents: DataFrame) -> DataFrame | None:
    """doc_ids that rows with different texts share, with the digest of the text that keeps the doc_id as its key; None if there are none."""
    digest = F.xxhash64("text")
    rows = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    found = materialize(rows.groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("shared"), "lo"))
    if found.limit(1).count():
        return found
    release(found)
    return None


def _keyed(documents: DataFrame, several: DataFrame | None, name: str) -> DataFrame:
    """``documents`` with a column ``name``, equal for rows that are one document: the doc_id, or for further texts of one a key beyond all doc_ids."""
    if several is None:
        return documents.withColumn(name, F.col("doc_id"))
    shared, lo = free_names(documents, "shared", "lo")
    near = several.toDF(shared, lo)
    near = F.broadcast(near) if several.count() <= BROADCAST_ROWS else near
    top = max(0, documents.agg(F.max("doc_id")).first()[0])
    other = F.lit(top + 1) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(KEYS))
    joined = documents.join(near, documents["doc_id"] == F.col(shared), "left")
    first = F.col(lo).isNull() | F.col("text").isNull() | (F.xxhash64("text") == F.col(lo))
    return joined.withColumn(name, F.when(first, F.col("doc_id")).otherwise(other)).drop(shared, lo)


def repeated_passages(documents: DataFrame, least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """One row per passage of a document (words start to end, exclusive) that an earlier one holds."""
    docs = documents.select("doc_id", "text")
    several = _several(docs)
    keyed = _keyed(docs, several, "key")
    out = _passages(keyed.select(F.col("key").alias("doc_id"), "text"), least, identity)
    if several is None:
        return out
    # Keys of further texts go back to their doc_ids.
    names = materialize(keyed.where("key <> doc_id").select("key", F.col("doc_id").alias("of")).distinct())
    for column in ("doc_id", "first_doc_id"):
        out = out.join(names, out[column] == names["key"], "left").withColumn(column, F.coalesce("of", column)).drop("key", "of")
    return out.select(*[c.split()[0] for c in PASSAGE.split(", ")])


def _passages(documents: DataFrame, least: int, identity: float) -> DataFrame:
    """As ``repeated_passages``, for rows that are the same document if they have the same doc_id."""
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    buckets = max(24, docs.count() // DOCS_PER_BUCKET)
    sent = docs.mapInArrow(_sent(buckets), _SENT)
    met = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_met, _MATCH)
    matches = met.groupBy("b").agg(F.collect_list(F.struct("a", "p", "q")).alias("matches"))
    found = materialize(matches.mapInArrow(_chained(least), _CHAINS), LOADS_AT_ONCE)
    asked = materialize(found.select("b", "a", "size", "p").mapInArrow(_asked, "b long, a long, block int"))
    blocks = asked.groupBy(F.col("a").alias("doc_id")).agg(F.collect_set("block").alias("blocks"))
    ids = materialize(asked.select(F.col("a").alias("doc_id")).distinct())
    fetched = _of(docs, ids).join(blocks, "doc_id").select(F.col("doc_id").alias("a"), "text", "blocks").mapInArrow(_fetched, "a long, block int, words binary")
    fetched = fetched.groupBy("a", "block").agg(F.min("words").alias("words"))
    given = asked.join(fetched, ["a", "block"]).groupBy("b").agg(F.collect_list(F.struct("a", "block", "words")).alias("fetched"))
    own = _of(docs, materialize(found.select(F.col("b").alias("doc_id")))).groupBy(F.col("doc_id").alias("b")).agg(F.min("text").alias("text"))
    out = materialize(own.join(found, "b").join(given, "b").select("b", "text", "a", "size", "p", "q", "fetched").mapInArrow(_aligned(least, identity), PASSAGE), DOCS_AT_ONCE)
    release(found, asked, ids)
    return out


def _united(key: str, name: str):
    """Spans of each document without overlaps: those that touch become one."""

    def run(batches):
        for docs, spans in tv.rows(batches, [key, name]):
            starts, ends, size = [], [], []
            for m in spans:
                start, end = (m.values.field(f).to_numpy() for f in ("start", "end"))
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                starts.append(start[first])
                ends.append(end[np.append(first[1:], len(end)) - 1])
                size.append(len(first))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int32), pa.int32()) for x in (starts, ends)], ["start", "end"])
            edge = pa.array(np.cumsum([0, *size]), pa.int32())
            yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(edge, flat)], [key, name])

    return run


def _cut(name: str):
    """Texts without the words of the spans in this column, a slice of a batch at a time."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            sizes = [len(off) - 1 for _, _, off in tv.slices(batch.column(k), SLICE)]
            for i, size in zip(np.cumsum([0, *sizes]).tolist(), sizes, strict=False):
                yield _without_spans(batch.slice(i, size), name)
            del batch
        tv.give_back()

    return run


def _without_spans(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    texts = batch.column(batch.schema.get_field_index("text"))
    spans = batch.column(batch.schema.get_field_index(name))
    new = texts.to_pylist()
    for i, buf, off in tv.slices(texts):
        for k in range(len(off) - 1):
            if not spans[i + k].is_valid or new[i + k] is None:
                continue
            raw = buf[off[k] : off[k + 1]]
            starts, _, _ = tv.bounds(raw, np.array([0, len(raw)]))
            edge = np.append(starts, len(raw))
            keep, gone = np.ones(len(raw), bool), np.zeros(len(starts), bool)
            for s in spans[i + k].as_py():
                s0, s1 = s["start"], min(s["end"], len(starts))
                gone[s0:s1] = True
                if s0 < s1:
                    keep[edge[s0] : edge[s1]] = False
            new[i + k] = None if gone.all() else raw[keep].tobytes().decode("utf-8")
    names = [f for f in batch.schema.names if f != name]
    cols = [pa.array(new, pa.string()) if f == "text" else batch.column(batch.schema.get_field_index(f)) for f in names]
    gone = pa.array([a is None and b.is_valid for a, b in zip(new, texts, strict=True)], pa.bool_())
    return pa.RecordBatch.from_arrays(cols, names).filter(pa.compute.invert(gone))


def drop_repeats(documents: DataFrame, least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """``documents`` without passages that an earlier document holds; rows of which nothing remains go."""
    import pyarrow.compute  # noqa: F401

    several = _several(documents)
    key, own, spans_ = free_names(documents, "key", "own", "spans")
    keyed = _keyed(documents, several, own)
    found = _passages(keyed.select(F.col(own).alias("doc_id"), "text"), least, identity)
    spans = found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "end")).alias(spans_))
    spans = materialize(spans.mapInArrow(_united(key, spans_), f"`{key}` long, `{spans_}` array<struct<start: int, end: int>>"))
    near = F.broadcast(spans) if (spans.agg(F.sum(F.size(spans_) + 1)).first()[0] or 0) <= BROADCAST_SPANS else spans
    joined = keyed.join(near, F.col(own) == F.col(key), "left").drop(key, own)
    out = joined.mapInArrow(_cut(spans_), documents.schema)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(documents.schema["n_chars"].dataType))
    # Written here, as whoever writes it may hand whole texts to Python in batches of any size.
    return materialize(out.select(*documents.columns))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
