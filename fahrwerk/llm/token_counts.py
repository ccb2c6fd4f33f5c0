"""Token counts with a whole-token shortcut.

Before any text is read, each worker proves which vocabulary pieces that
stand for a whole word encode alone as that one token.  A text is cut where
a space follows something else than a space, where no piece reaches across
(this too is checked on the vocabulary); a cut part that equals a proven
piece counts one, all others are merged by the library, each distinct one
once while it stays in a bounded cache.

Null texts are empty and count 0.  Texts that hold the library's own mark
for a space are given to it whole.  Rows are counted each on its own, so rows
that repeat a doc_id or a text have equal counts (there are no ties to break);
very long texts are cut in the same way.  An empty table gives an empty
result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textvec as tv
from .vocab import Bounded, vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
CACHED_CHARS = 64


class Counter:
    """Counts the tokens of texts in one sentencepiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: True if no piece has a space after something else, so that words are independent.
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.whole = self.prove(pieces)
        # A space after which the text ends.
        self.whole[""] = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.known = Bounded()
        self.known.update(self.whole)

    def prove(self, pieces: list[str]) -> dict[str, int]:
        """The words whose encoding is one token, by encoding each of them."""
        words = [p[1:] for p in pieces if p.startswith(SPACE) and len(p) > 1 and SPACE not in p[1:]]
        return {w: 1 for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True) if len(ids) == 1}

    def _rest(self, part: str) -> int:
        n = len(self.model.encode(part))
        if len(part) <= CACHED_CHARS:
            if len(self.known) >= self.known.limit:
                self.known.clear()
                self.known.update(self.whole)
            self.known[part] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if SPACE in text or not self.words_apart:
            return len(self.model.encode(text))
        parts = text.split(" ")
        if "" in parts:
            parts = self._with_runs(parts)
        found = list(map(self.known.get, parts))
        if None in found:
            found = [self._rest(p) if n is None else n for p, n in zip(parts, found, strict=True)]
        return sum(found)

    @staticmethod
    def _with_runs(parts: list[str]) -> list[str]:
        """Runs of spaces stay with the word that follows, or alone at the end."""
        out, run = [], 0
        for p in parts:
            if p:
                out.append(" " * run + p)
                run = 0
            else:
                run += 1
        if run:
            out.append(" " * (run - 1))
        return out


_counters: dict[str, Counter] = {}


def counter(name: str = VOCABULARY) -> Counter:
    if name not in _counters:
        _counters[name] = Counter(vocabulary_path(name))
    return _counters[name]


def _run(name: str, limit: int):
    def run(batches):
        c = counter(name)
        for ids, texts in tv.rows(batches, ["doc_id", "text"]):
            size, n = [], []
            for t in texts:
                t = t.as_py() or ""
                size.append(len(t.encode("utf-8")))
                n.append(c.count(t))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``) of each row."""
    return documents.select("doc_id", "text").mapInArrow(_run(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
