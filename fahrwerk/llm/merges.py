"""Byte-pair merges of many short words at once, as numpy arrays.

Words of one length are rows of a matrix of symbols.  Each round joins, in
every row, the leftmost pair of the lowest rank, and looks up the two pairs
that are new beside it; rows in which no pair is left are done.
"""

from __future__ import annotations

import numpy as np

from .bpe_codec import byte_letters

_NONE = np.int32(1 << 30)


class Merges:
    """The merge list of a byte-level vocabulary whose words end in a suffix; ``model`` is that part of its file."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.inner, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for letter, byte in byte_letters().items():
            self.inner[byte], self.last[byte] = vocab[letter], vocab[letter + end]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pairs.setdefault(vocab[a] << 24 | vocab[b], (rank, vocab[a + b]))
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.zeros(len(merges), np.int32)
        for rank, made in pairs.values():
            self.made[rank] = made
        # Ranks of two bytes side by side, inside a word and at its end.
        every = np.repeat(self.inner[:, None], 256, axis=1)
        self.beside, self.ending = (self.ranks(every, np.repeat(x[None, :], 256, axis=0)) for x in (self.inner, self.last))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 24 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers; no word may hold a line end."""
        out = np.full(len(words), b"", object)
        raw = np.frombuffer(("\n".join(words) + "\n").encode("utf-8"), np.uint8)
        ends = np.flatnonzero(raw == 10) if words else np.zeros(0, np.int64)
        starts = np.append(0, ends[:-1] + 1)[: len(ends)]
        length = ends - starts
        order = np.argsort(length, kind="stable")
        edge = np.searchsorted(length[order], [1, *range(2, int(length.max(initial=0)) + 2)])
        for n, (low, high) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True), 1):
            for i in range(low, high, 20_000):
                which = order[i : min(i + 20_000, high)]
                held = raw[starts[which][:, None] + np.arange(n)]
                rank = np.hstack([self.beside[held[:, :-2], held[:, 1:-1]], self.ending[held[:, -2:-1], held[:, -1:]]]) if n > 1 else np.zeros((len(held), 0), np.int32)
                for rows, ids in self._merged(np.hstack([self.inner[held[:, :-1]], self.last[held[:, -1:]]]), rank):
                    out[which[rows]] = np.ascontiguousarray(ids.astype("<u4")).view(f"V{4 * ids.shape[1]}").ravel().tolist()
        return out.tolist()

    def _merged(self, ids: np.ndarray, rank: np.ndarray):
        """Yields (rows, their ids) by the number of ids that remain; ``rank`` has that of each pair."""
        rows, n = np.arange(len(ids)), ids.shape[1]
        while len(rows):
            if n == 1:
                yield rows, ids
                return
            best = rank.argmin(axis=1)
            low = rank[np.arange(len(rows)), best]
            more = low < _NONE
            if not more.all():
                yield rows[~more], ids[~more]
                rows, ids, rank, best, low = rows[more], ids[more], rank[more], best[more], low[more]
            # What stands behind the joined pair moves one place to the front.
            line, place = np.arange(len(rows)), np.arange(n - 1)
            ids[line, best] = self.made[low]
            ids = np.take_along_axis(ids, place + (place > best[:, None]), axis=1)
            rank = np.take_along_axis(rank, np.minimum(place[:-1] + (place[:-1] >= best[:, None]), n - 2), axis=1)
            n -= 1
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.ranks(ids[left, best[left] - 1], ids[left, best[left]])
            right = np.flatnonzero(best < n - 1)
            rank[right, best[right]] = self.ranks(ids[right, best[right]], ids[right, best[right] + 1])
