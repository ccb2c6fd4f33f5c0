"""Sequence packing by minimum bin slack.

Each document's ids, with one end id, are cut at multiples of the window;
full pieces are sequences of their own, the rest is packed.  Documents are
dealt evenly to shards by a hash.  In a shard only the counts of remaining
lengths matter: the longest remaining one opens a window, and a bitset
subset-sum over the other lengths (each as often as it remains) finds the
multiset that fills the window closest to its capacity; walking back through
the bitsets gives the counts, and the found pattern is used as often as the
counts allow.

Null texts are empty: one piece with the end id alone.  Rows that repeat a
doc_id are packed as often as they occur, each with its own pieces.  No id is
dropped or repeated.  Pieces of equal length are taken in order of doc_id and
start; very long texts give many full pieces.  An empty table gives an empty
result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain, compress, repeat
from operator import concat, is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import materialize
from .merges import Merges
from .vocab import vocabulary_path

VOCABULARY = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
DOCS_PER_SHARD = 4096
CACHED_CHARS = 48
#: Words that a task remembers (some 60 MB); they go with it, as workers are used again for other operators.
CACHE_LIMIT = 300_000
#: Fixed value: how the vocabulary's pattern ends; a run of letters is one pre-token, other marks but single digits are another.
WORD_PATTERN = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = re.compile("[\u0300-\U0010ffff]")
#: By byte: 1 for a-z, 2 for ASCII marks, 0 for all others; and which bytes after 0xC3 make a letter below U+0100 in lower case.
_KIND = np.zeros(256, np.int8)
_KIND[97:123] = 1
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_SECOND = np.zeros(256, np.int8)
_SECOND[0x9F:0xC0] = 1
_SECOND[0xB7] = 0
#: Bytes of texts whose words are looked up at once.
SLICE = 2_000_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _kinds(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Which words are letters below U+0100 in lower case alone, in which ASCII marks follow them, and how many marks in each of those."""
    raw = np.frombuffer(("\n".join(words) + "\n").encode("utf-8"), np.uint8)
    kind = _KIND[raw]
    first = np.flatnonzero(raw == 0xC3)
    kind[first] = kind[first + 1] = _SECOND[raw[first + 1]]
    ends = np.flatnonzero(raw == 10)
    starts = np.append(0, ends[:-1] + 1)
    letters = np.append(0, np.cumsum(kind == 1, dtype=np.int32))
    marks = np.append(0, np.cumsum(kind == 2, dtype=np.int32))
    head, tail = letters[ends] - letters[starts], marks[ends] - marks[starts]
    ordered = (head > 0) & (head + tail == ends - starts) & (letters[starts + head] - letters[starts] == head)
    marked = ordered & (tail > 0)
    return ordered & (tail == 0), marked, tail[marked].tolist()


class Words:
    """Ids of texts, word by word: no pre-token of this vocabulary holds white space.

    Words of letters below U+0100 are one pre-token, which ``Merges`` encodes,
    many at once, also where ASCII marks follow; all others go to the library.  That the vocabulary's parts
    are those that this relies on is checked at the start.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if steps != ["NFC", "Replace", "Lowercase"] or not pattern.endswith(WORD_PATTERN) or any(not t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError(f"{path} does not cut texts at white space, in lower case")
        self.merges = Merges(spec["model"])
        del spec  # before the library reads the file once more
        self.model = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        tv.give_back()

    def learn(self, words: set[str]) -> None:
        """Encodes new words, none of which holds a line end; marks at a word's end are a pre-token of their own."""
        new, known = list(words), self.known
        whole, marked, marks = _kinds(new)
        plain, ending = list(compress(new, whole)), list(compress(new, marked))
        heads, tails = [w[:-n] for w, n in zip(ending, marks, strict=True)], [w[-n:] for w, n in zip(ending, marks, strict=True)]
        plain += set(heads).difference(known, plain)
        known.update(zip(plain, self.merges.encode(plain), strict=True))
        other = list(compress(new, (~(whole | marked)).tolist()))
        other += set(tails).difference(known, other)
        known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(other, self.model.encode_batch_fast(other, add_special_tokens=False), strict=True))
        known.update(zip(ending, map(concat, map(known.__getitem__, heads), map(known.__getitem__, tails)), strict=True))
        for head in {h for h in heads if len(h) > CACHED_CHARS}.difference(words):
            del known[head]

    @staticmethod
    def plain(text: str) -> list[str]:
        """Parts between spaces and line ends, in lower case where that can't change more than single letters."""
        if "<|" not in text and (text.isascii() or not _MARKS.search(text)):
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.plain(t) for t in texts]
        every = list(chain.from_iterable(parts))
        found = list(map(self.known.get, every))
        missing = list(compress(range(len(every)), map(is_, found, repeat(None))))
        new = {every[k] for k in missing}
        if len(self.known) + len(new) > CACHE_LIMIT:
            # Words that are met again now mostly are frequent ones; the others are forgotten.
            self.known = {"": b""} | {w: ids for w, ids in zip(every, found, strict=True) if ids is not None}
        if new:
            self.learn(new)
        for k in missing:
            found[k] = self.known[every[k]]
        out, at = [], 0
        for p in parts:
            out.append(b"".join(found[at : at + len(p)]))
            at += len(p)
        for w in new:
            if len(w) > CACHED_CHARS:
                del self.known[w]
        return out


_words: dict[str, Words] = {}


def words(name: str = VOCABULARY) -> Words:
    if name not in _words:
        _words[name] = Words(vocabulary_path(name))
    return _words[name]


def _pieces(name: str, window: int):
    def run(batches):
        w = words(name)
        end = np.array([END_ID], "<u4").tobytes()
        for ids, texts in tv.rows(batches, ["doc_id", "text"]):
            ids = ids.to_pylist()
            for i, _, off in tv.slices(texts, SLICE):
                size = len(off) - 1
                doc, start, length, crc, total = [], [], [], [], []
                for d, packed in zip(ids[i : i + size], w.encode([t or "" for t in texts.slice(i, size).to_pylist()]), strict=True):
                    packed += end
                    n = len(packed) // 4
                    for s in range(0, n, window):
                        part = packed[4 * s : 4 * (s + window)]
                        doc.append(d)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        w.known = {"": b""}

    return tv.trimmed(run)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of at most these counts whose sum is closest to ``room``, not above it."""
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        for _ in range(min(counts[size], room // size)):
            more = (reach | reach << size) & mask
            if more == reach:
                break
            layers.append((size, reach))
            reach = more
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for size, before in reversed(layers):
        if not before >> at & 1:
            at -= size
            used[size] = used.get(size, 0) + 1
    return used


def bins(counts: dict[int, int], window: int = WINDOW):
    """Yields (pattern of lengths, times used) until all counts are used."""
    left = dict(counts)
    while left:
        top = max(left)
        left[top] -= 1
        if not left[top]:
            del left[top]
        used = fill(left, window - top)
        left[top] = left.get(top, 0) + 1
        used[top] = used.get(top, 0) + 1
        times = min(left[s] // n for s, n in used.items())
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        yield used, times


def pack_shard(length: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of a shard."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    waiting = {int(s): order[np.searchsorted(ordered, s) : np.searchsorted(ordered, s, "right")].tolist() for s in np.unique(length)}
    number = 0
    for used, times in bins({s: len(x) for s, x in waiting.items()}, window):
        for _ in range(times):
            at = 0
            for s in sorted(used, reverse=True):
                for _ in range(used[s]):
                    k = waiting[s].pop()
                    sequence[k], offset[k] = number, at
                    at += s
            number += 1
    return sequence, offset


def _pack(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        sequence, offset = pack_shard(table["length"].to_numpy(), window)
        base = table["shard"].to_numpy() << 32
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset))

    return run


def pack_documents(documents: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """One row per piece: where it starts in its document, and its sequence and offset there.

    Shards hold ``docs_per_shard`` documents on average, so that a shard's
    memory doesn't depend on the corpus, and all but its last sequence are
    full or nearly full.
    """
    docs = documents.select("doc_id", "text")
    shards = max(1, docs.count() // docs_per_shard)
    # Written here, as whoever writes the result may hand whole texts to Python in batches of any size.
    pieces = materialize(docs.mapInArrow(_pieces(vocabulary, window), PIECE))
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).alias("shard")
    return pieces.select(shard, "*").groupBy("shard").applyInArrow(_pack(window), f"{PIECE}, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
