"""BPE encoding by a bounded-lookahead transducer, and decoding by a state machine.

For a merge list in which every token is made from earlier ones, a prefix of
a pre-token has exactly one last token: the one that ends there, starts where
another prefix ends, and whose seam with that prefix's last token no merge
would close.  The lookahead is computed from the merge list: the bytes of the
longest token that the merges build from its own bytes, as no other ever comes
out.  The last tokens of so many latest prefixes decide all that follows; what
all of them descend from is stable, is emitted at once and forgotten, so that
memory doesn't grow with a pre-token's length.

Texts are fed in chunks that start at a space before something else than
white space, where the pre-tokenizer's pattern always starts anew; short
chunks are remembered in a bounded cache.

Null texts are empty: no tokens, and the digests of nothing.  An empty table
gives an empty result.  Text length is not limited; a row is encoded as it
stands, repeats and ties included; columns beyond doc_id and text are not
read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textvec as tv
from .vocab import CACHE_LIMIT, Bounded, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_CHARS = 48
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.id = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: t for t, i in self.id.items()} | {i: t.encode() for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), r)
            self.made.setdefault(z, (r, x, y))
        self.split = regex.compile(PATTERN)
        self.mark = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.seam = Bounded()
        self.first, self.later = Bounded(), Bounded()
        self.words = Bounded(CACHE_LIMIT // 2)
        # Tokens that the merges don't build from their own bytes never come out.
        self.usable = {t: i for t, i in self.id.items() if len(t) == 1 or i in self.made}
        self.finder = ahocorasick.Automaton()
        for t, i in self.usable.items():
            self.finder.add_word(t.decode("latin-1"), (len(t), i))
        self.finder.make_automaton()
        self.lookahead = self.sufficient_lookahead()

    def sufficient_lookahead(self) -> int:
        """Prefixes that decide what follows: the bytes of the longest token that the merges build from its own bytes."""
        return next(len(t) for t in sorted(self.usable, key=len, reverse=True) if self._self_made(t))

    def joins(self, left: int, right: int) -> bool:
        """Whether some merge would close the seam between two neighbouring tokens.

        Walks the inner edges of both tokens forward in the order of the
        merges that built them; the seam closes if two edge parts merge
        while both are there.
        """
        known = self.seam.get((left, right))
        if known is not None:
            return known
        a, x = [], left
        while x in self.made:  # (part, the merge that makes it, the one that takes it in)
            a.append(x)
            x = self.made[x][2]
        a.append(x)
        b, y = [], right
        while y in self.made:
            b.append(y)
            y = self.made[y][1]
        b.append(y)
        a.reverse()
        b.reverse()
        i = j = 0
        closed = False
        while True:
            born = max(self.made[a[i]][0] if i else -1, self.made[b[j]][0] if j else -1)
            dies_a = self.made[a[i + 1]][0] if i + 1 < len(a) else NEVER
            dies_b = self.made[b[j + 1]][0] if j + 1 < len(b) else NEVER
            r = self.rank.get((a[i], b[j]))
            if r is not None and born < r < dies_a and r <= dies_b:
                closed = True
                break
            if dies_a == dies_b == NEVER:
                break
            if dies_a <= dies_b:
                i += 1
            else:
                j += 1
        return self.seam.put((left, right), closed)

    def stream(self, data: bytes):
        """Ids of one pre-token, each as soon as it is stable."""
        whole = self.usable.get(data)
        if whole is not None and self._self_made(data):
            yield whole
            return
        usable, joins, reach = self.usable, self.joins, self.lookahead
        start = [None, None]
        live = deque([start], maxlen=reach + 1)  # (token, what it follows) of the latest prefixes
        emitted = start
        for end in range(1, len(data) + 1):
            node = None
            for size in range(min(end, reach, len(live)), 0, -1):
                token = usable.get(data[end - size : end])
                if token is None:
                    continue
                back = live[-size]
                if back is None or (back[0] is not None and joins(back[0], token)):
                    continue
                node = [token, back]
                break
            live.append(node)
            if end % (4 * reach) == 0:
                stable = self._common([x for x in live if x is not None], emitted)
                yield from self._between(emitted, stable)
                stable[1], emitted = None, stable  # what lies before it is not needed any more
        if live[-1] is None:
            raise ValueError("the lookahead is too short for these merges")
        yield from self._between(emitted, live[-1])

    def _self_made(self, data: bytes) -> bool:
        """True if the merges turn a token's bytes into that token: its halves meet at a seam that closes last."""
        known = self.seam.get(data)
        if known is None:
            made = self.made.get(self.usable[data])
            known = made is None
            if made:
                _, x, y = made
                known = self._self_made(self.bytes[x]) and self._self_made(self.bytes[y]) and self._closes_whole(x, y)
            self.seam.put(data, known)
        return known

    def _closes_whole(self, x: int, y: int) -> bool:
        """Whether x and y stay whole until the merge that joins them: no smaller edge parts merge first."""
        a, b = [x], [y]
        while a[-1] in self.made:
            a.append(self.made[a[-1]][2])
        while b[-1] in self.made:
            b.append(self.made[b[-1]][1])
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                r = self.rank.get((p, q))
                if r is None or (i == 0 and j == 0):
                    continue
                born = max(self.made[p][0] if p in self.made else -1, self.made[q][0] if q in self.made else -1)
                dies_p = self.made[a[i - 1]][0] if i else NEVER
                dies_q = self.made[b[j - 1]][0] if j else NEVER
                if born < r < dies_p and r <= dies_q:
                    return False
        return True

    @staticmethod
    def _between(old, new) -> list[int]:
        out = []
        while new is not old:
            out.append(new[0])
            new = new[1]
        return out[::-1]

    @staticmethod
    def _common(nodes, root):
        """The last node from which all of these descend, none before ``root``."""
        paths = []
        for n in nodes:
            path = []
            while n is not root and n is not None and n[0] is not None:
                path.append(n)
                n = n[1]
            if n is not root:
                continue  # older than what was emitted
            paths.append(path[::-1])
        last = root
        for step in zip(*paths, strict=False):
            if any(x is not step[0] for x in step):
                break
            last = step[0]
        return last

    def short(self, data: bytes) -> list[int]:
        """As ``stream`` for a pre-token that is shorter than the lookahead: all of it is in view."""
        seam, joins = self.seam.get, self.joins
        n = len(data)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        # The tokens that end at each place, the longest first.
        for end, (size, token) in self.finder.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                closed = seam((before, token))
                if closed is None:
                    closed = joins(before, token)
                if closed:
                    continue
            elif not self._self_made(data[:end]):
                continue
            last[end], back[end] = token, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def ids(self, piece: str) -> list[int]:
        """Ids of a chunk, special strings as their own ids."""
        out: list[int] = []
        for k, part in enumerate(self.mark.split(piece) if self.mark else [piece]):
            if k % 2:
                out.append(self.special[part])
                continue
            for word in self.split.findall(part):
                known = self.words.get(word)
                if known is None:
                    data = word.encode("utf-8")
                    if len(data) > CACHED_CHARS:
                        out.extend(self.stream(data))
                        continue
                    known = self.words.put(word, self.short(data))
                out.extend(known)
        return out

    def _packed(self, piece: str) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids) if (ids := self.ids(piece)) else b""

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        parts = text.split(" ")
        found = list(map(self.later.get, parts))
        found[0] = self.first.get(parts[0])
        if None in found:
            for i, p in enumerate(parts):
                if found[i] is None:
                    if i and (not p or p[0].isspace()):
                        return self._by_runs(parts)
                    found[i] = self._packed(" " + p if i else p)
                    if len(p) <= CACHED_CHARS:
                        (self.later if i else self.first).put(p, found[i])
        return b"".join(found)

    def _by_runs(self, parts: list[str]) -> bytes:
        """As ``encode``, for texts where white space follows a space: such parts stay together."""
        out, run = [], [parts[0]]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(self._packed("".join(run)))
                run = []
            run.append(" " + p)
        out.append(self._packed("".join(run)))
        return b"".join(out)

    def decode(self, packed: bytes, block: int = 65_536):
        """Yields the text of ids, block by block; an unfinished character waits for its last bytes."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        ids = np.frombuffer(packed, dtype="<u4")
        for i in range(0, len(ids), block):
            yield machine.decode(b"".join(map(self.bytes.__getitem__, ids[i : i + block].tolist())))
        yield machine.decode(b"", True)


_codecs: dict[str, Codec] = {}


def codec(name: str = VOCABULARY) -> Codec:
    """The codec of a vocabulary, made once in each worker."""
    if name not in _codecs:
        _codecs[name] = Codec(vocabulary_path(name))
    return _codecs[name]


def _digests(name: str):
    def run(batches):
        c = codec(name)
        for ids, texts in tv.rows(batches, ["doc_id", "text"]):
            n, enc, dec = [], [], []
            for t in texts:
                packed = c.encode(t.as_py() or "")
                n.append(len(packed) // 4)
                enc.append(hashlib.sha256(packed).hexdigest())
                h = hashlib.sha256()
                for part in c.decode(packed):
                    h.update(part.encode("utf-8"))
                dec.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _ids(name: str):
    def run(batches):
        c = codec(name)
        for ids, texts in tv.rows(batches, ["doc_id", "text"]):
            packed = [np.frombuffer(c.encode(t.as_py() or ""), "<u4").astype(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(packed, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return run


def encode_texts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the token ids of each text."""
    return documents.select("doc_id", "text").mapInArrow(_ids(vocabulary), "doc_id long, ids array<long>")


def round_trip_digests(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encodes and decodes each text; returns the number of tokens and digests of both."""
    return documents.select("doc_id", "text").mapInArrow(
        _digests(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
