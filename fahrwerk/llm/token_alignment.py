"""Alignment of two tokenizers' tokens on the bytes of each text, and how common linked id pairs are.

A text is read as a space and the text, which is what both tokenizers encode
(A is given the space, B adds it).  A token ends at a byte offset; where
tokens of both end, the text is cut into groups.  The common ends are found
by galloping intersection: the shorter end list drives, and each of its ends
is searched in the longer one from the last place found, in steps that
double, then by bisection between the last two.  The places found slice both
lists into groups, and differences of ranks in the other list give the range
of tokens that a token's bytes overlap: its links.

Neither tokenizer joins a character that isn't white space with a space after
it, so texts are cut there into chunks, whose ends are common ends.  Each
distinct chunk is encoded and aligned once while it stays in a bounded cache;
texts are aligned chunk by chunk, from first to last.

How many documents hold an id pair linked is counted over the whole corpus.
Tasks go through slices of texts and send, for each slice, its distinct pairs
with the number of its documents that hold them.  Spark adds these up by
pair, finds the largest count of each A id, and joins both back to the
slices' pairs (a pair that all texts hold is one row a slice; skewed joins
are split).  Each slice then sums over its documents' links, which were
written beside the pairs as places in the slice's list of chunks.

Null and empty texts, and texts whose joined A or B bytes differ from a space
and the text, have no tokens: all numbers are 0 and groups_sha256 is empty;
they hold no pairs.  Special tokens' strings inside texts are plain text.
Rows that repeat a doc_id or a text are documents of their own.  Rows without
doc_id are aligned and counted, too.  Ties for the highest count all are
best.  Very long texts are a slice of their own.  An empty table gives an
empty result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .bpe_codec import byte_letters
from .common import materialize, release
from .vocab import vocabulary_path

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of the texts of a slice; a longer text is a slice of its own.
SLICE = 2_000_000
#: Chunks of up to so many characters are remembered, so many of them.
CACHED_CHARS, CACHE_LIMIT = 48, 250_000
#: New chunks that are aligned at once, and those that are encoded as one string.
TOGETHER, STRING = 20_000, 200
SPACE = "▁"
_CUT = re.compile(r"(?<=\S)(?= )")
_RUN = re.compile(r"\s ")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that begin at offsets (one more at the end); runs may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def gallop(short: np.ndarray, long: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each number of ``short`` the first place between its ``low`` and ``high`` where ``long``, ascending there, isn't below it.

    All searches go on side by side: steps double until the number isn't
    below, then the last step is bisected.
    """
    low, top = low.copy(), high
    high, step, live = low.copy(), 1, np.arange(len(short))
    while len(live):
        live = live[high[live] < top[live]]
        live = live[long[high[live]] < short[live]]
        low[live] = high[live] + 1
        high[live] += step
        step *= 2
    high = np.minimum(high, top)
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) // 2
        below = long[mid] < short[live]
        low[live] = np.where(below, mid + 1, low[live])
        high[live] = np.where(below, high[live], mid)
        live = live[low[live] < high[live]]
    return low


def align_ends(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in a and in b of the common ends, places in a and in b of tokens whose bytes overlap).

    Both lists of ends are cut into chunks that begin at ``first_a`` and
    ``first_b`` (one more at the end) and end at the same offsets.  In each
    chunk the shorter list drives.
    """
    a_drives = np.diff(first_a) <= np.diff(first_b)
    found = []
    for short, long, first, other, drives in ((a, b, first_a, first_b, a_drives), (b, a, first_b, first_a, ~a_drives)):
        size = np.where(drives, np.diff(first), 0)
        chunk = np.repeat(np.arange(len(size)), size)
        i = np.arange(len(chunk)) + np.repeat(first[:-1] - (np.cumsum(size) - size), size)
        rank = gallop(short[i], long, other[:-1][chunk], other[1:][chunk])
        same = long[rank] == short[i] if len(i) else np.zeros(0, bool)
        # From the token in which the last end lies, or behind it, to the one in which this end lies.
        begin = np.concatenate([[0], rank + same])[:-1]
        head = i == first[:-1][chunk]
        begin[head] = other[:-1][chunk][head]
        n = rank - begin + 1
        spread = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
        pair = (i[same], rank[same], np.repeat(i, n), spread)
        found.append(pair if short is a else (pair[1], pair[0], pair[3], pair[2]))
    both_a, both_b, link_a, link_b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(both_a)
    return both_a[order], both_b[order], link_a, link_b


class Aligner:
    """Both tokenizers, and the chunks that were aligned last.

    Of each chunk are kept its numbers of tokens and groups, its linked id
    pairs (A << 16 | B) and its groups as text; ``good`` says whether both
    tokenizers give its bytes back.
    """

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = byte_letters()
        vocab = json.load(open(first, encoding="utf-8"))["model"]["vocab"]
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if token in vocab and all(c in letters for c in token) else token.encode("utf-8")
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = _BYTE.fullmatch(piece)
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode("utf-8"))
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # Ids as text with what follows them: a comma, a bar (A) or a semicolon (B) at a group's end.
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.decimal = np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(most)], object)
        self.width = np.array([len(x) for x in self.decimal], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.figures = np.zeros((4, 0), np.int64)
        self.links, self.groups = [], []

    def encode_b(self, parts: list[str]) -> list[list[int]]:
        """B's ids of chunks, each without its first space; an empty one is a space at the end of a text."""
        out = self.b.encode(parts, num_threads=1)
        if "" in parts:
            last = self.b.encode("a ")[len(self.b.encode("a")) :]
            out = [ids if p else last for p, ids in zip(parts, out, strict=True)]
        return out

    def tokens(self, parts: list[str], ends: np.ndarray, whole: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        """For A and B all ids of these strings, their ends in bytes, and which of them begin a chunk (ends of chunks are given); None if bytes or bounds differ."""
        out = []
        for lists, bytes_, sizes in (([e.ids for e in self.a.encode_batch_fast([f" {p}" for p in parts], add_special_tokens=False)], self.bytes_a, self.size_a), (self.encode_b(parts), self.bytes_b, self.size_b)):
            ids = list(chain.from_iterable(lists))
            if b"".join(map(bytes_.__getitem__, ids)) != whole:
                return None
            ids = np.array(ids, np.int64)
            at = np.cumsum(sizes[ids])
            last = np.searchsorted(at, ends)
            if not np.array_equal(at[last], ends):
                return None
            out.append((ids, at, np.concatenate([[0], last + 1])))
        return out

    def learn(self, parts: list[str]) -> None:
        """Aligns new chunks, given without their first space."""
        # Chunks that end in something else than white space may follow each other in one string.
        plain = [p for p in parts if p and not p[-1].isspace()]
        other = [p for p in parts if not p or p[-1].isspace()]
        for i in range(0, len(plain), TOGETHER):
            self._learn(plain[i : i + TOGETHER], True)
        if other:
            self._learn(other, False)

    def _learn(self, parts: list[str], joined: bool) -> None:
        raw = [f" {p}".encode() for p in parts]
        size, whole = np.array([len(x) for x in raw], np.int64), b"".join(raw)
        strings = [" ".join(parts[i : i + STRING]) for i in range(0, len(parts), STRING)] if joined else parts
        found = self.tokens(strings, np.cumsum(size), whole)
        if found is None:
            if len(parts) > 1:
                for p in parts:
                    self._learn([p], False)
                return
            # The tokenizers don't give this chunk back.
            self._keep(parts, np.zeros((4, 1), np.int64), [np.zeros(0, np.uint32)], [b""])
            return
        (ids_a, ends_a, first_a), (ids_b, ends_b, first_b) = found
        both_a, both_b, link_a, link_b = align_ends(ends_a, ends_b, first_a, first_b)
        links = (ids_a[link_a] << 16 | ids_b[link_b]).astype(np.uint32)
        of = np.searchsorted(first_a, link_a, "right") - 1
        order = np.argsort(of, kind="stable")
        wide = np.bincount(of, minlength=len(parts))
        # All groups' text in one string: each group's A ids, then its B ids.
        most = len(self.decimal) // 3
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[both_a], last_b[both_b] = True, True
        place = np.concatenate([2 * np.searchsorted(both_a, np.arange(len(ids_a))), 2 * np.searchsorted(both_b, np.arange(len(ids_b))) + 1])
        spot = np.concatenate([ids_a + most * last_a, ids_b + 2 * most * last_b])[np.argsort(place, kind="stable")]
        text = b"".join(self.decimal[spot].tolist())
        letters = sums(self.width[spot], first_a + first_b)
        stop = np.cumsum(letters)
        groups = [text[i:j] for i, j in zip((stop - letters).tolist(), (stop - 1).tolist(), strict=True)]
        n_groups = np.diff(np.searchsorted(both_a, first_a))
        figures = np.stack([np.diff(first_a), np.diff(first_b), n_groups, np.ones(len(parts), np.int64)])
        links, edge = links[order], np.cumsum(wide)
        self._keep(parts, figures, [links[i:j] for i, j in zip((edge - wide).tolist(), edge.tolist(), strict=True)], groups)

    def _keep(self, parts: list[str], figures: np.ndarray, links: list, groups: list[bytes]) -> None:
        n = len(self.groups)
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.figures = np.concatenate([self.figures, figures], axis=1)
        self.links += links
        self.groups += groups

    @staticmethod
    def parts(text: str | None) -> list[str]:
        """Chunks of a text, each without its first space; none if it has no tokens."""
        if not text or SPACE in text:
            return []
        if not _RUN.search(f" {text} x"):
            return text.split(" ")
        return [c[1:] for c in _CUT.split(f" {text}")]

    def chunks(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Numbers of the distinct chunks of these texts, and each text as places among them; empty where a chunk isn't given back."""
        parts = [self.parts(t) for t in texts]
        found = set().union(*parts)
        new = found.difference(self.known)
        if len(self.known) + len(new) > CACHE_LIMIT:
            self.forget()
            new = found
        if new:
            self.learn(sorted(new))
        rows = [np.fromiter(map(self.known.__getitem__, x), np.int64, len(x)) for x in parts]
        rows = [r if self.figures[3][r].all() else r[:0] for r in rows]
        numbers, places = np.unique(np.concatenate([*rows, np.zeros(0, np.int64)]), return_inverse=True)
        for p in new:
            if len(p) > CACHED_CHARS:
                del self.known[p]
        return numbers, np.split(places, np.cumsum([len(r) for r in rows])[:-1])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(first: str = FIRST, second: str = SECOND) -> Aligner:
    if (first, second) not in _aligners:
        _aligners[first, second] = Aligner(vocabulary_path(first), vocabulary_path(second))
    return _aligners[first, second]


#: Kind 0: a slice's distinct pairs, with how many of its documents hold each.  Kind 1: the slice's documents.
_SENT = "kind int, slice long, pair long, n long, docs binary, chunks binary"
_SENT_NAMES = [c.split()[0] for c in _SENT.split(", ")]


def _packed(*columns) -> bytes:
    """Columns of one table as bytes."""
    table = pa.table({str(i): c for i, c in enumerate(columns)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> list:
    return pa.ipc.open_stream(raw).read_all().columns


def _slice(number: int, ids: pa.Array, both: Aligner, texts: list[str | None]):
    """What a slice sends."""
    numbers, rows = both.chunks(texts)
    links = [both.links[k] for k in numbers.tolist()]
    width = np.array([len(x) for x in links], np.int64)
    links, begin = np.concatenate([*links, np.zeros(0, np.uint32)]), np.cumsum(width) - width
    length = np.array([len(r) for r in rows], np.int64)
    every = np.concatenate([*rows, np.zeros(0, np.int64)])
    # Distinct chunks of each document, then its distinct pairs.
    keys, times = np.unique((np.repeat(np.arange(len(rows)), length) << 32) | every, return_counts=True)
    doc, chunk = keys >> 32, keys & 0xFFFFFFFF
    n = width[chunk]
    at = np.arange(int(n.sum())) + np.repeat(begin[chunk] - (np.cumsum(n) - n), n)
    held = np.unique((np.repeat(doc, n).astype(np.uint64) << np.uint64(32)) | links[at])
    pair, count = np.unique((held & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)
    per_doc = [sums(f[numbers][every], np.concatenate([[0], np.cumsum(length)])) for f in both.figures[:3]]
    groups = [both.groups[k] for k in numbers.tolist()]
    digest = [hashlib.sha256(b";".join(map(groups.__getitem__, r.tolist()))).hexdigest() if len(r) else "" for r in rows]
    kinds = np.bincount(doc, minlength=len(rows))
    lists = lambda values, starts: pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values.astype(np.int32)))
    edge = np.cumsum(kinds) - kinds
    docs = _packed(ids, *(pa.array(x) for x in per_doc), pa.array(digest, pa.string()), lists(chunk, edge), lists(times, edge))
    # Links of the chunks as places among the slice's pairs.
    chunks = _packed(lists(np.searchsorted(pair, links), begin))
    for i in range(0, len(pair), 50_000):
        p, c = pair[i : i + 50_000].astype(np.int64), count[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(p), np.int32)), pa.array(np.full(len(p), number)), pa.array(p), pa.array(c.astype(np.int64)), pa.nulls(len(p), pa.binary()), pa.nulls(len(p), pa.binary())], _SENT_NAMES)
    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([number]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([docs], pa.binary()), pa.array([chunks], pa.binary())], _SENT_NAMES)


def _slices(first: str, second: str):
    def run(batches):
        both = aligner(first, second)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        waiting_ids, waiting, size = [], [], 0
        for ids, texts in tv.rows(batches, ["doc_id", "text"]):
            for i in range(len(ids)):
                text = texts[i].as_py()
                length = len(text or "")
                if waiting and size + length > SLICE:
                    yield from _slice(number, pa.array(waiting_ids, pa.int64()), both, waiting)
                    number += 1
                    waiting_ids, waiting, size = [], [], 0
                waiting_ids.append(ids[i].as_py())
                waiting.append(text)
                size += length
        if waiting:
            yield from _slice(number, pa.array(waiting_ids, pa.int64()), both, waiting)
        both.forget()

    return run


FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _figures(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Figures of a slice's documents from the corpus-wide counts of its pairs."""
    names = [c.split()[0] for c in FIGURES.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in FIGURES.split(", ")]
    if not docs.num_rows:
        return pa.table([pa.array([], t) for t in types], names)
    order = np.argsort(pairs["pair"].to_numpy())
    count, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy()[order]
    ids, n_a, n_b, n_groups, digest, chunk, times = (c.combine_chunks() for c in _unpacked(docs["docs"][0].as_py()))
    (spots,) = (c.combine_chunks() for c in _unpacked(docs["chunks"][0].as_py()))
    at, edge = spots.values.to_numpy(), spots.offsets.to_numpy()
    own = [np.diff(edge).astype(np.int64), sums((count[at] == best[at]).astype(np.int64), edge), sums(count[at], edge)]
    which, often, bounds = chunk.values.to_numpy(), times.values.to_numpy(), chunk.offsets.to_numpy()
    per_doc = [sums(x[which] * often, bounds) for x in own]
    return pa.table([ids, n_a, n_b, n_groups, *(pa.array(x, pa.int64()) for x in per_doc), digest], names)


def linked_pairs(sent: DataFrame) -> DataFrame:
    """pair (A << 16 | B), the number of documents that hold it linked, and the highest such number of its A id."""
    counts = materialize(sent.groupBy("pair").agg(F.sum("n").alias("count")))
    best = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("count").alias("best"))
    return counts.join(best, F.shiftright("pair", 16) == F.col("a")).select("pair", "count", "best")


def alignment_figures(documents: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """Per document: its tokens, groups and links, and how common its linked id pairs are in the corpus."""
    sent = materialize(documents.select("doc_id", "text").mapInArrow(_slices(first, second), _SENT), by="kind")
    pairs = sent.where("kind = 0").select("slice", "pair", "n")
    counted = pairs.select("slice", "pair").join(linked_pairs(pairs), "pair").select("slice", "pair", "count", "best")
    docs = sent.where("kind = 1").select(F.col("slice").alias("own"), "docs", "chunks")
    out = materialize(docs.groupBy("own").cogroup(counted.groupBy("slice")).applyInArrow(_figures, FIGURES))
    release(sent)
    return out


def aligned_groups(documents: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """doc_id and groups: for each group its A ids and its B ids, in order."""

    def run(batches):
        both = aligner(first, second)
        for ids, texts in tv.rows(batches, ["doc_id", "text"]):
            out = []
            for i in range(0, len(ids), 64):
                numbers, rows = both.chunks(texts.slice(i, 64).to_pylist())
                for r in rows:
                    found = [g.split("|") for k in numbers[r].tolist() for g in both.groups[k].decode().split(";")]
                    out.append([{"a": [int(x) for x in a.split(",")], "b": [int(x) for x in b.split(",")]} for a, b in found])
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.struct({"a": pa.list_(pa.int32()), "b": pa.list_(pa.int32())})))], ["doc_id", "groups"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_figures(spark.read.parquet(f"{sf_dir}/documents.parquet"))
