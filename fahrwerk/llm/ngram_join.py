"""N-gram Jaccard self-join by PartEnum signatures.

A document is the set of its distinct 5-word shingles (64-bit hashes).  Sets
r and s with Jaccard similarity of at least t differ in at most
``d = (1 - t) / (1 + t) * (|r| + |s|)`` elements.  Sizes are cut into bands of
ratio 1 / t; in the band of the larger set the difference is at most ``k``.
The hash domain is cut into ``n1 > k / 2`` partitions of three parts.  By
pigeonhole some partition holds at most one difference, so that one of its
three choices of two parts is the same in both sets: each such choice is one
signature, and similar sets share one.  A set takes part in its own band and,
as the smaller one, in the next.

A partition is *full* in a set if two of its parts hold elements.  Of F full
partitions, one with no difference shares three signatures that hold
elements, one with a single difference shares one.  So similar sets share at
least ``max(2 F - d, 3 F - 2 d)`` of them; a pair that shares fewer is
dropped.  Choices without elements would be shared by all: a set emits them
only if it is *weak* (F <= k / 2); if one of a similar pair is not weak, they
share a choice with elements, and if both are, both emit all.

Groups of equal signatures with at most SMALL sets give all their pairs, with
how often they meet.  Larger groups never give pairs.  There a set keeps only
its smallest groups, all but so many as it must share with any similar set
less one (a prefix filter, which loses no pair), and members are compared in
blocks inside tasks, which give a spanning forest of the links: first in
three groups of each set, where each block meets itself and one other, then
in the groups that still hold several components.  There counts of elements
in cells are compared first, and only members whose counts leave room for a
link with another component travel as sets.  Every link is confirmed on the
full sets.

Null or empty texts have no shingles and link with nothing, as rows without
doc_id do, whose component_id is null.  Equal texts are one set (a copy costs
a row, not a comparison).  Ties go to the smallest doc_id; rows that repeat a
doc_id are kept and share its component; very long texts have larger sets,
nothing else; columns beyond doc_id and text are not read.  An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import connected_components, materialize, release

SHINGLE = 5
PERCENT = 75
#: Partitions of the domain, as a multiple of the least number that the pigeonhole needs.
SPARE = 1.2
#: Choices of two of the three parts of a partition.
CHOICES = ((0, 1), (0, 2), (1, 2))
#: Groups of up to so many sets give all their pairs.
SMALL = 32
#: Sets and elements of a block of a larger group.
BLOCK, BLOCK_ELEMENTS = 512, 250_000
#: Groups, each with all its members, that a task hands to Python at once.
GROUPS_AT_ONCE = 16
#: Shingles that are compared at once.
COLUMNS = 2048
CHUNK = 256
#: Names of sets (24 bytes each) are broadcast up to this number of rows; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
DOCS_PER_BUCKET = 5_000
#: Bytes of texts whose sets a task holds at once.
SLICE = 1_000_000
#: Sets whose signatures a task has sent, as far as it remembers; a forgotten one is sent again.
SENT = 500_000
#: Cells of the hash domain in which the elements of a set are counted, in a byte each: what two sets have in common is at most the sum of the lesser counts.
CELLS = 128
#: Members of a group whose counts in cells are compared at once, and least cells (as bits); a set has two to four elements a cell on average.
COUNTED, LEAST_BITS = 2048, 6
#: Rows, each with the signatures of a slice in a bucket, that a task hands to Python at once.
LOADS_AT_ONCE = 100
#: A bucket's signatures are grouped in so many ranges (as bits), one after the other.
RANGE_BITS = 3
_U = np.uint64


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, and where each text's begin (one more at the end)."""
    starts, ends, first = tv.bounds(buf, off)
    words = tv.word_hashes(buf, starts, ends)
    runs = tv.grams(words, k)
    size, parts = np.zeros(len(first) - 1, np.int64), []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            parts.append(np.sort(runs[a : b - k + 1]) if b - a >= k else tv.mix(tv.grams(words[a:b], b - a) + _U(b - a)))
            size[i] = len(parts[-1])
    if not parts:
        return np.zeros(0, _U), np.zeros(len(first), np.int64)
    h, doc = np.concatenate(parts), np.repeat(np.arange(len(size)), size)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(size)))])


def set_ids(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit name (signed, even) of each set, equal for equal sets; 0 for the empty one."""
    size, out = np.diff(off), np.zeros(len(off) - 1, _U)
    some = np.flatnonzero(size)
    if len(some):
        sums = np.add.reduceat(tv.mix(h ^ _U(0x5851F42D4C957F2D)), off[:-1][some])
        out[some] = tv.mix(sums + size[some].astype(_U)) << _U(1)
    return out.view(np.int64)


def band_tops(limit: int, percent: int = PERCENT) -> np.ndarray:
    """Largest sizes of the bands: each band reaches up to its smallest size / t."""
    tops, low = [], 1
    while not tops or tops[-1] < limit:
        tops.append(max(low, low * 100 // percent))
        low = tops[-1] + 1
    return np.array(tops, np.int64)


def most_apart(total, percent: int = PERCENT):
    """Elements in which similar sets of this size together differ at most."""
    return (100 - percent) * total // (100 + percent)


def signatures(h: np.ndarray, off: np.ndarray, band: np.ndarray, percent: int = PERCENT):
    """(set, signature) of all signatures of sets in the given bands, and each set's number of full partitions.

    Sets of bands where only equal sets are similar have no signatures.
    """
    size = np.diff(off)
    k = most_apart(2 * band_tops(1 << 40, percent)[band], percent)
    n1 = np.where(k > 0, np.maximum(1, np.ceil(SPARE * (k + 1) / 2).astype(np.int64)), 0)
    doc = np.repeat(np.arange(len(size)), size)
    if not (k > 0).all():
        keep = (k > 0)[doc]
        h, doc = h[keep], doc[keep]
    base = np.concatenate([[0], np.cumsum(3 * n1)])
    cell = ((h >> _U(32)) * (3 * n1).astype(_U)[doc] >> _U(32)).astype(np.int64) + base[doc]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    sums, held = np.zeros(base[-1], _U), np.zeros(base[-1], bool)
    if len(first):
        sums[cell[first]] = np.add.reduceat(tv.mix(h), first)
        held[cell[first]] = True
    sums, held = sums.reshape(-1, 3), held.reshape(-1, 3)
    of = np.repeat(np.arange(len(size)), n1)
    full = np.bincount(of[held.sum(axis=1) > 1], minlength=len(size))
    weak = (full <= k // 2)[of]
    partition = (np.arange(len(of)) - base[:-1][of] // 3).astype(_U)
    found = []
    for c, (x, y) in enumerate(CHOICES):
        some = held[:, x] | held[:, y]
        value = np.where(some, sums[:, x] + sums[:, y], partition + _U(0x9E3779B97F4A7C15))
        ok = some | weak
        found.append((of[ok], tv.mix(value[ok] ^ tv.mix((band[of[ok]].astype(_U) << _U(8)) + _U(c + 1)))))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), full


class Bands:
    """Signatures of sets in their own band and in the next."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, band_tops(1 << 40, percent)

    def sides(self, h: np.ndarray, off: np.ndarray):
        """Yields (1 if as the smaller set in the next band, sets, (set, signature) of theirs, full partitions)."""
        size = np.diff(off)
        own = np.searchsorted(self.tops, size)
        for step in (0, 1):
            which = np.flatnonzero((size > 0) & ((step == 0) | (100 * size >= self.percent * (self.tops[own] + 1))))
            if len(which):
                part = h if len(which) == len(size) else h[np.isin(np.repeat(np.arange(len(size)), size), which)]
                row, sig, full = signatures(part, np.concatenate([[0], np.cumsum(size[which])]), own[which] + step, self.percent)
                yield step, which, which[row], sig, full


#: Rows that tasks send: kind 0 a document, 1 a set in a band, 2 the signatures of a slice's sets in a bucket, set by set.
_SENT = "bucket int, kind int, id long, node long, n long, full long, lost long, nodes binary, ns binary, counts binary, sigs binary"
_SENT_NAMES = [c.split()[0] for c in _SENT.split(", ")]


def _sent(bucket, kind, ident, node, n, full, lost) -> pa.RecordBatch:
    size = len(node)
    wide = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int64), size).copy(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(np.full(size, kind), pa.int32()), ident if isinstance(ident, pa.Array) else wide(ident), wide(node), wide(n), wide(full), wide(lost), *[pa.nulls(size, pa.binary())] * 4],
        _SENT_NAMES,
    )


def _sent_signatures(bucket, loads) -> pa.RecordBatch:
    size = len(bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(size, 2), pa.int32()), *[pa.nulls(size, pa.int64())] * 5, *(pa.array(x, pa.binary()) for x in loads)], _SENT_NAMES)


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest takes."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def widened(raw: bytes, size: int) -> np.ndarray:
    """The ``size`` numbers of ``narrow``."""
    return np.frombuffer(raw, f"u{len(raw) // size}").astype(np.int64)


def _emit(buckets: int, percent: int):
    """Describes each document, and sends the signatures of every set that the task has not sent before, dealt into buckets."""

    def run(batches):
        bands, sent = Bands(percent), set()
        width = max(1, (buckets - 1).bit_length())
        for ids, texts in tv.rows(batches, ["doc_id", "text"]):
            for i, buf, off in tv.slices(texts, SLICE):
                h, at = shingle_sets(buf, off)
                names, size = set_ids(h, at), np.diff(at)
                own = ids.slice(i, len(names))
                spread = tv.mix(own.cast(pa.int64()).fill_null(0).to_numpy().view(_U)) % _U(buckets)
                yield _sent(spread.astype(np.int32), 0, own, names, size, 0, 0)
                new = []
                for k in np.flatnonzero((size > 0) & own.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    if int(names[k]) not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(int(names[k]))
                        new.append(k)
                step = 1 << (31 - width)
                for j in range(0, len(new), step):
                    part = np.array(new[j : j + step])
                    inside = np.zeros(len(size), bool)
                    inside[part] = True
                    ph = h[np.repeat(inside, size)]
                    yield from _signed(bands, ph, np.concatenate([[0], np.cumsum(size[part])]), names[part], buckets, width)

    return run


def _signed(bands: Bands, h, off, names, buckets: int, width: int):
    size = np.diff(off)
    for step, which, row, sig, full in bands.sides(h, off):
        node = names | step
        # Sorted by bucket, set and the signature's other bits; signatures of one set that fall together are counted.
        key = ((sig & _U(0xFFFFFFFF)) * _U(buckets) >> _U(32) << _U(64 - width)) | (row.astype(_U) << _U(32)) | (sig >> _U(32))
        key = np.sort(key)
        key = key[np.diff(key, prepend=key[:1] ^ _U(1)) != 0]
        place = key >> _U(32)
        rows = (place & _U((1 << (32 - width)) - 1)).astype(np.int64)
        lost = np.bincount(row, minlength=len(size)) - np.bincount(rows, minlength=len(size))
        yield _sent((tv.mix(node[which].view(_U)) % _U(buckets)).astype(np.int32), 1, 0, node[which], size[which], full, lost[which])
        if not len(key):
            continue
        first = np.flatnonzero(np.diff(place, prepend=place[:1] ^ _U(1)) != 0)
        ends = np.append(first[1:], len(key))
        of, held = rows[first], (place[first] >> _U(32 - width)).astype(np.int32)
        edge = np.flatnonzero(np.diff(held, prepend=-1))
        low, counts, loads = (key & _U(0xFFFFFFFF)).astype(np.uint32), ends - first, []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(first)], strict=True):
            loads.append((node[of[a:b]].tobytes(), narrow(size[of[a:b]]), narrow(counts[a:b]), low[first[a] : ends[b - 1]].tobytes()))
        yield _sent_signatures(held[edge], zip(*loads, strict=True))


#: What buckets give: 0 documents (doc_id, set, size), 1 sets in a band, 2 pairs (a, b, times), 3 members of large groups (node, group, size).
_SHARED = "kind int, a long, b long, x long, y long, z long"


def _shared_rows(kind: int, *columns) -> pa.RecordBatch:
    size = len(columns[0])
    columns = [*columns, *[np.zeros(size, np.int64)] * (5 - len(columns))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind), pa.int32()), *(c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns)], ["kind", "a", "b", "x", "y", "z"])


def _shared(percent: int):
    """Groups of equal signatures in a bucket; documents and sets pass through."""

    def run(batches):
        parts = []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            for k in (0, 1):
                b = batch.filter(pa.array(kind == k))
                if b.num_rows and k == 0:
                    yield _shared_rows(0, b.column(2), b.column(3), b.column(4))
                elif b.num_rows:
                    yield _shared_rows(1, b.column(3), b.column(4), b.column(5), b.column(6))
            parts.append(batch.filter(pa.array(kind == 2)).select(["bucket", "nodes", "ns", "counts", "sigs"]))
        if not sum(p.num_rows for p in parts):
            return
        t = pa.Table.from_batches(parts)
        parts = []
        bucket = t["bucket"].to_numpy().astype(_U)
        for b in np.unique(bucket).tolist():
            loads = t.filter(pa.array(bucket == b)).select(["nodes", "ns", "counts", "sigs"]).to_pydict()
            held = [len(x) // 8 for x in loads["nodes"]]
            nodes, every = np.frombuffer(b"".join(loads["nodes"]), np.int64), np.frombuffer(b"".join(loads["sigs"]), np.uint32)
            ns, counts = (np.concatenate([widened(x, k) for x, k in zip(loads[c], held, strict=True)]) for c in ("ns", "counts"))
            # Rows are in the order of their names; what several tasks have sent counts once.
            names, at = np.unique(nodes, return_index=True)
            ns, rank = ns[at], np.full(len(nodes), len(names), np.uint32)
            rank[at] = np.arange(len(names), dtype=np.uint32)
            of = np.repeat(rank, counts)
            if len(names) < len(nodes):
                every, of = every[of < len(names)], of[of < len(names)]
            # A range of signatures at a time, for the memory of a task.
            for part in range(1 << RANGE_BITS):
                own = every >> np.uint32(32 - RANGE_BITS) == part
                yield from _groups(b, every[own], of[own], names, ns, percent)
            del loads, every, of
        del t, parts
        tv.give_back()

    return tv.trimmed(run)


def _groups(bucket: int, sig: np.ndarray, row: np.ndarray, names: np.ndarray, ns: np.ndarray, percent: int):
    """What groups of equal signatures give, where row i has the name names[i] and ns[i] elements."""
    key = np.sort((sig.astype(_U) << _U(32)) | row)
    sig, row = key >> _U(32), (key & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(sig, prepend=sig[:1] ^ _U(1)) != 0)
    size = np.diff(np.append(first, len(sig)))
    # Only groups of several sets, one of which at least is in its own band.
    used = (size > 1) & (np.minimum.reduceat(names[row] & 1, first) == 0) if len(first) else size > 1
    first, size = first[used], size[used]
    if not len(first):
        return
    big = size > SMALL
    pairs = [np.zeros(0, _U)]
    for k in np.unique(size[~big]).tolist():
        m = row[first[size == k][:, None] + np.arange(k)]
        i, j = np.triu_indices(k, 1)
        a, b = m[:, i].ravel(), m[:, j].ravel()
        ok = (100 * np.minimum(ns[a], ns[b]) >= percent * np.maximum(ns[a], ns[b])) & ((names[a] & names[b] & 1) == 0) & (names[a] | 1 != names[b] | 1)
        pairs.append(a[ok].astype(_U) << _U(32) | b[ok].astype(_U))
    pairs, times = np.unique(np.concatenate(pairs), return_counts=True)
    yield _shared_rows(2, names[(pairs >> _U(32)).astype(np.int64)], names[(pairs & _U(0xFFFFFFFF)).astype(np.int64)], times)
    if big.any():
        gid = tv.mix(sig[first[big]] << _U(24) ^ _U(bucket)).view(np.int64)
        at = np.repeat(first[big] - (np.cumsum(size[big]) - size[big]), size[big]) + np.arange(int(size[big].sum()))
        yield _shared_rows(3, names[row[at]], np.repeat(gid, size[big]), np.repeat(size[big], size[big]))


def _sets(batches):
    """The set of each document that stands for one."""
    for cid, texts in tv.rows(batches, ["cid", "text"]):
        for i, buf, off in tv.slices(texts, SLICE):
            h, at = shingle_sets(buf, off)
            want = cid.slice(i, len(off) - 1)
            ok = set_ids(h, at) == want.to_numpy()  # another row with the same doc_id may have another text
            keep = np.flatnonzero(ok)
            raw, cells = h.tobytes(), cell_counts(h, at)
            yield pa.RecordBatch.from_arrays(
                [want.filter(pa.array(ok)), pa.array(np.diff(at)[keep], pa.int64()), pa.array([raw[8 * at[k] : 8 * at[k + 1]] for k in keep.tolist()], pa.binary()), pa.array([cells[k].tobytes() for k in keep.tolist()], pa.binary())],
                ["cid", "n", "s", "cells"],
            )


def cell_counts(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each set how many elements fall into each cell; 255 stands for as many or more."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    counts = np.bincount(doc * CELLS + (h >> _U(57)).astype(np.int64), minlength=(len(off) - 1) * CELLS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, CELLS)


def _possible(percent: int):
    """Pairs whose counts in cells leave room for enough common elements."""

    def run(batches):
        for a, b, n, m, x, y in tv.rows(batches, ["a", "b", "na", "nb", "xa", "xb"]):
            if not len(a):
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, CELLS) for c in (x, y))
            n, m = n.to_numpy(), m.to_numpy()
            common = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            ok = pa.array((100 * common >= percent * (n + m - common)) | ((x == 255) & (y == 255)).any(axis=1))
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches):
        for a, b, x, y in tv.rows(batches, ["a", "b", "sa", "sb"]):
            ok = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p.as_buffer(), _U), np.frombuffer(q.as_buffer(), _U)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of set names (a, b) that are similar in full; a set with very many partners is spread over tasks."""
    counts = lambda c: sets.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("cells").alias(f"x{c}"))
    pairs = materialize(pairs.join(counts("a"), "a").join(counts("b"), "b").mapInArrow(_possible(percent), "a long, b long"))
    named = materialize(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
    sets = sets.join(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, "cid", "left_semi")
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("salt"))
    left = chunks.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").select("a", "sa", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("salt"))
    both = dealt.join(left, ["a", "salt"]).join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    out = materialize(both.select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long"))
    release(pairs, named)
    return out


def common_counts(values: np.ndarray, row: np.ndarray, rows: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common values of each row of ``left`` with each of ``right``; (value, row) pairs are distinct."""
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    column = np.cumsum(np.diff(values, prepend=values[:1]) != 0)
    of = np.bincount(column)
    shared = of[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, total, COLUMNS):
        s = slice(*np.searchsorted(column, [c, c + COLUMNS]))
        part = np.zeros((rows, min(COLUMNS, total - c)), np.float32)
        part[row[s], column[s] - c] = 1
        out += part[left] @ part[right].T
    return out


def _forests(percent: int, bits: int):
    """A spanning forest of the links between different components in each pair of blocks."""

    def run(batches):
        for i, j, members in tv.rows(batches, ["i", "j", "members"]):
            a, b = [], []
            for x, y, m in zip(i.to_pylist(), j.to_pylist(), members, strict=True):
                flat = m.values
                block, cid, comp, n = (flat.field(f).to_numpy() for f in ("block", "cid", "comp", "n"))
                order = np.argsort(cid)
                values = [np.frombuffer(v.as_buffer(), _U if bits == 64 else np.uint32) for v in flat.field("s")]
                values = [values[k] for k in order.tolist()]
                block, cid, comp, n = block[order], cid[order], comp[order], n[order]
                left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
                row = np.repeat(np.arange(len(n)), [len(v) for v in values])
                # Elements of one set that fall together in so few bits may each be common ones.
                lost = n - np.array([len(v) for v in values])
                common = common_counts(np.concatenate(values), row, len(n), left, right).astype(np.int64)
                common += np.minimum(lost[left][:, None], lost[right][None, :])
                link = 100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)
                link &= comp[left][:, None] != comp[right][None, :]
                near = np.zeros((len(n), len(n)), bool)
                near[np.ix_(left, right)] |= link
                near |= near.T
                free = near.any(axis=1)
                for root in np.flatnonzero(free).tolist():
                    front = np.array([root]) if free[root] else np.zeros(0, np.int64)
                    free[root] = False
                    while len(front):
                        to = np.flatnonzero(near[front].any(axis=0) & free)
                        a += cid[front[near[np.ix_(front, to)].argmax(axis=0)]].tolist() if len(to) else []
                        b += cid[to].tolist()
                        free[to] = False
                        front = to
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def folded_counts(h: np.ndarray, bits: int) -> np.ndarray:
    """How many elements fall into each of so many cells (as bits); 255 stands for as many or more."""
    return np.minimum(np.bincount((h >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def _counted(batches):
    """Each set with the counts of its elements in cells."""
    for cid, n, s in tv.rows(batches, ["cid", "n", "s"]):
        bits = [max(LEAST_BITS, k.bit_length() - 2) for k in n.to_pylist()]
        counts = [folded_counts(np.frombuffer(v.as_buffer(), _U), b).tobytes() for v, b in zip(s, bits, strict=True)]
        yield pa.RecordBatch.from_arrays([cid, n, pa.array(counts, pa.binary())], ["cid", "n", "cells"])


def possible_partners(counts: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of ``left`` and ``right`` have room for enough common elements, by counts in cells (one row a set)."""
    common = np.zeros((len(left), len(right)), np.float32)
    x, y = counts[left], counts[right]
    for least in range(1, int(counts.max(initial=0)) + 1):
        # Cells in which a set of either side holds so many.
        some = np.flatnonzero((x >= least).any(axis=0) & (y >= least).any(axis=0))
        if not len(some):
            break
        common += (x[:, some] >= least).astype(np.float32) @ (y[:, some] >= least).astype(np.float32).T
    full = (counts == 255).any(axis=1)
    return ((100 + percent) * common.astype(np.int64) >= percent * (n[left][:, None] + n[right][None, :])) | (full[left][:, None] & full[right][None, :])


def _partnered(percent: int):
    """Members of a pair of blocks that have a possible partner of another component there."""

    def run(batches):
        for gid, i, j, members in tv.rows(batches, ["gid", "i", "j", "members"]):
            out = []
            for g, x, y, m in zip(gid.to_pylist(), i.to_pylist(), j.to_pylist(), members, strict=True):
                flat = m.values
                block, cid, comp, n = (flat.field(f).to_numpy() for f in ("block", "cid", "comp", "n"))
                raw = [np.frombuffer(v.as_buffer(), np.uint8) for v in flat.field("cells")]
                # Neighbouring cells are taken together, down to as many as the least set has.
                width = min(map(len, raw))
                counts = np.stack([np.minimum(v.reshape(width, -1).sum(axis=1, dtype=np.int64), 255).astype(np.uint8) if len(v) > width else v for v in raw])
                left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
                ok = possible_partners(counts, n, left, right, percent) & (comp[left][:, None] != comp[right][None, :])
                which = np.union1d(left[ok.any(axis=1)], right[ok.any(axis=0)])
                out.append((np.full(len(which), g), cid[which], comp[which]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["gid", "cid", "comp"])

    return run


def _as_one(members: DataFrame) -> DataFrame:
    """Members of the groups that hold several components; groups whose members have the same smallest hash are one."""
    alike = members.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.xxhash64("cid")).alias("least")).where("lo <> hi")
    return members.join(alike.select("gid", "least"), "gid").select(F.col("least").alias("gid"), "cid", "comp").distinct()


def partnered(members: DataFrame, sets: DataFrame, percent: int, star: bool = False) -> DataFrame:
    """Members (gid, cid, comp) that have a possible partner in their group and another component.

    Only counts in cells travel, a tenth or so of a set's bytes; but for a
    ``star`` no link is lost.
    """
    counted = sets.select("cid", "n", "s").mapInArrow(_counted, "cid long, n long, cells binary")
    placed = _placed(_as_one(members).join(sets.select("cid", "n"), "cid"), COUNTED, 1 << 40, star)
    together = placed.join(counted, "cid").groupBy("gid", "i", "j").agg(F.collect_list(F.struct("block", "cid", "comp", "n", "cells")).alias("members"))
    return together.mapInArrow(_partnered(percent), "gid long, cid long, comp long").distinct()


def _placed(sized: DataFrame, most: int, most_elements: int, star: bool) -> DataFrame:
    """Members in blocks, once for each pair of blocks (i, j) that is compared; ``sized`` has gid, cid, comp, n.

    Members of the component that has most of a group lie in blocks of their
    own, which are never compared with one another.  A ``star`` only compares
    each block with itself and with one other, the same for all: three rows a
    member at most, however large the group.
    """
    parts = sized.groupBy("gid", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    whole = parts.groupBy("gid").agg(F.sum("size").alias("size"), F.sum("total").alias("total"), F.max(F.struct("size", "total", "comp")).alias("main"))
    blocks = lambda size, total: F.ceil(F.greatest(size / most, total / most_elements)).cast("int")
    main = F.struct(F.lit(0).alias("size"), F.lit(0).alias("total"), F.lit(None).cast("long").alias("comp")) if star else F.col("main")
    whole = whole.withColumn("main", main).select("gid", F.col("main.comp").alias("main"), blocks(F.col("size") - F.col("main.size"), F.col("total") - F.col("main.total")).alias("rest"), blocks(F.col("main.size"), F.col("main.total")).alias("own"))
    # Blocks of the other components come first.
    inside, first = F.coalesce(F.col("comp") == F.col("main"), F.lit(False)), F.lit(0)
    block = F.when(inside, F.col("rest") + F.pmod(F.xxhash64("cid"), F.col("own"))).otherwise(F.pmod(F.xxhash64("cid"), F.col("rest"))).cast("int")
    if star:
        others = F.when(F.col("block") == 0, F.sequence(first, F.col("rest") - 1)).otherwise(F.array(first, F.col("block")))
    else:
        others = F.sequence(first, F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("own")) - 1)
    placed = sized.join(whole, "gid").where("rest > 0").withColumn("block", block).withColumn("other", F.explode(others))
    return placed.select("gid", "cid", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def group_links(members: DataFrame, sets: DataFrame, percent: int, bits: int = 32, star: bool = False) -> DataFrame:
    """Links (a, b) of the groups that hold several components; ``members`` has gid, cid, comp.

    Sets travel as numbers of ``bits`` bits, which may take too many elements
    for common ones; the links are to be confirmed.  Groups whose members have
    the same smallest hash, as groups with nearly the same members mostly do,
    are compared as one, so that a set travels once for all of them.  A
    ``star`` finds most links, not all.
    """
    placed = _placed(_as_one(members).join(sets.select("cid", "n"), "cid"), BLOCK, BLOCK_ELEMENTS, star)

    def narrowed(batches):
        for cid, n, s in tv.rows(batches, ["cid", "n", "s"]):
            small = [(np.frombuffer(v.as_buffer(), _U) >> _U(32)).astype(np.uint32) for v in s]
            yield pa.RecordBatch.from_arrays([cid, n, pa.array([np.unique(v).tobytes() for v in small], pa.binary())], ["cid", "n", "s"])

    loads = sets if bits == 64 else sets.select("cid", "n", "s").mapInArrow(narrowed, "cid long, n long, s binary")
    together = placed.join(loads, "cid").groupBy("gid", "i", "j").agg(F.collect_list(F.struct("block", "cid", "comp", "n", "s")).alias("members"))
    return together.select("i", "j", "members").mapInArrow(_forests(percent, bits), "a long, b long").distinct()


def _least_shared(full: Column, apart: Column) -> Column:
    """Signatures that similar sets share at least, from full partitions and the elements that differ."""
    return F.greatest(F.lit(1), 2 * full - apart, 3 * full - 2 * apart)


def jaccard_components(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``documents``.

    Two documents link if 100 * |intersection| >= percent * |union| of their
    shingle sets; component_id is the smallest doc_id reachable by links.
    """
    docs = documents.select("doc_id", "text")
    buckets = max(24, docs.count() // DOCS_PER_BUCKET)
    rows = docs.mapInArrow(_emit(buckets, percent), _SENT)
    shared = materialize(rows.repartitionById(buckets, F.col("bucket")).mapInArrow(_shared(percent), _SHARED), LOADS_AT_ONCE, by="kind")
    table = shared.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("cid"), F.col("x").alias("n"))
    first = table.where("n > 0 and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))

    # Sets in their bands: what they must share at least with a similar set, and what they have in large groups.
    large = shared.where("kind = 3").select(F.col("a").alias("node"), F.col("b").alias("gid"), F.col("x").alias("size"))
    nodes = shared.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.first("b").alias("n"), F.first("x").alias("full"), F.first("y").alias("lost"))
    nodes = materialize(nodes.join(large.groupBy("node").agg(F.count("*").alias("held")), "node", "left").na.fill(0, ["held"]))

    # Pairs of small groups that share enough.
    pairs = shared.where("kind = 2").groupBy("a", "b").agg(F.sum("x").alias("times"))
    of = lambda k: nodes.toDF(k, f"n{k}", f"full{k}", f"lost{k}", f"held{k}")
    pairs = pairs.join(of("a"), "a").join(of("b"), "b")
    need = _least_shared(F.greatest("fulla", "fullb"), F.floor((F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent)))
    pairs = pairs.where(F.col("times") + F.least("helda", "heldb") + F.least("losta", "lostb") >= need)
    cid = lambda c: F.col(c).bitwiseAND(F.lit(-2))
    pairs = pairs.select(cid("a").alias("p"), cid("b").alias("q"), "times")
    pairs = materialize(pairs.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.max("times").alias("times")))

    # Members of large groups that can have a similar set which shares only such groups, in as few groups as it takes.
    most = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * (100 - percent) / (100 + percent))
    asked = nodes.where("held > 0").withColumn("spare", F.col("held") - _least_shared(F.col("full"), most) + F.col("lost") + 1).where("spare > 0")
    w = Window.partitionBy("node").orderBy("size", "gid")
    kept = large.join(asked.select("node", "spare"), "node").withColumn("rank", F.row_number().over(w)).where("rank <= spare")
    kept = materialize(kept.select(cid("node").alias("cid"), "gid", "rank", "spare"))

    # The sets themselves, of all that have pairs or groups.
    named = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(kept.select("cid")).distinct()
    named = materialize(named.join(first, "cid"))
    few_named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    sets = materialize(docs.join(few_named, "doc_id").select("cid", "text").mapInArrow(_sets, "cid long, n long, s binary, cells binary").dropDuplicates(["cid"]))

    # Each set with the partner it meets most, and in three of its groups.
    closest = pairs.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b")
    few = kept.where((F.col("rank") == 1) | (F.col("rank") == F.col("spare")) | (F.col("rank") == F.floor((F.col("spare") + 1) / 2)))
    few = materialize(partnered(few.select("gid", "cid", F.col("cid").alias("comp")).distinct(), sets, percent, star=True), GROUPS_AT_ONCE)
    begun = materialize(closest.union(group_links(few, sets, percent, star=True)).distinct(), GROUPS_AT_ONCE)
    links = confirmed(begun, sets, percent)
    comps = materialize(connected_components(links).toDF("cid", "comp"))

    # Then pairs and groups that still lie in different components.
    apart = pairs.join(comps.toDF("a", "ca"), "a", "left").join(comps.toDF("b", "cb"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    members = materialize(kept.select("gid", "cid").distinct().join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).select("gid", "cid", "comp"))
    more = confirmed(apart, sets, percent)
    likely = materialize(partnered(members, sets, percent), GROUPS_AT_ONCE)
    for bits in (32, 64):
        found = materialize(group_links(likely, sets, percent, bits), GROUPS_AT_ONCE)
        rest = confirmed(found, sets, percent)
        if bits == 64 or rest.count() == found.count():
            break
        release(found, rest)
    everything = materialize(connected_components(links.union(more).union(rest)).toDF("cid", "comp"))

    # From set names to the smallest doc_id of each component.
    whole = first.join(everything, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    lowest = whole.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_set = materialize(whole.join(lowest, "comp").select("cid", "component_id"))
    out = table.join(by_set.toDF("set", "component_id"), (F.col("cid") == F.col("set")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    out = materialize(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
    release(shared, nodes, pairs, kept, named, sets, few, begun, links, comps, members, likely, more, found, rest, everything, by_set)
    return out


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
