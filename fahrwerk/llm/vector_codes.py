"""Vector code compression: product codebooks, whose entries are found by Orchard's search.

Every component x becomes the integer floor(SCALE * x), and a vector is cut
into PARTS equal consecutive parts.  Each part position has a codebook of at
most ENTRIES entries, which starts as that part of the rows with the smallest
vec_ids.  A round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and replaces an entry by the floor of the
mean of its parts; entries that no part uses stay.

Orchard's search keeps for each entry the list of all entries by their
distance from it.  A search stands at one entry and walks along its list;
where it meets a closer entry it jumps to that one's list.  Entries that it
has met are marked and not measured again.  By the triangle inequality no
entry beyond twice the current distance can be closer, so it ends there.
Many searches walk side by side as numpy arrays, STEP places at a time.

Tasks send sums and counts of their parts by entry, which Spark adds up, so
that only the codebooks (PARTS * ENTRIES entries) pass through the driver.

Rows whose vector is null or holds null or non-finite components are dropped,
as are those (empty ones, too) whose length isn't the most frequent one, of
equally frequent ones the largest.  That length must be a multiple of PARTS;
otherwise vectors count as if zeros followed.  Rows that repeat a vec_id are
rows of their own, in order of their vectors; rows without one come last and
get codes.  Fewer rows than ENTRIES give as many entries.  Integers beyond
LIMIT count as LIMIT, errors beyond a long as the largest long.  An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 40
#: Places of a list that a search walks at once, and searches side by side.
STEP, SIDE = 16, 2048
LONGEST = (1 << 63) - 1
#: Labels whose sums are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers, within LIMIT, as whole doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -LIMIT, LIMIT)


def squared(x: np.ndarray) -> np.ndarray:
    """Sums of squares along the last axis."""
    return (x * x).sum(axis=-1) if x.dtype == object else np.einsum("...i,...i->...", x, x)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles where all squared distances are whole numbers below 2**53, else as Python integers."""
    width = max(1, arrays[0].shape[-1])
    most = max([0.0, *(float(np.abs(a).max()) for a in arrays if a.size)])
    if width * 16 * most * most < 1 << 53:  # four times a squared distance
        return list(arrays)
    whole = np.frompyfunc(int, 1, 1)
    return [whole(a) if a.size else a.astype(object) for a in arrays]


class Book:
    """The entries of one part position, and each entry's list of all entries by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = squared(entries[:, None] - entries[None])
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        sums = entries.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def begin(self, parts: np.ndarray) -> np.ndarray:
        """An entry for each part whose sum of components is near its own."""
        at = np.searchsorted(self.sums, parts.sum(axis=1)) if len(parts) else np.zeros(0, np.int64)
        return self.by_sum[np.minimum(at, len(self.sums) - 1)]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part."""
        k = len(self.entries)
        at = self.begin(parts)
        best = squared(parts - self.entries[at])
        met = np.zeros((len(parts), k), bool)
        met[np.arange(len(parts)), at] = True
        place, live = np.zeros(len(parts), np.int64), np.arange(len(parts))
        while len(live):
            spots = place[live][:, None] + np.arange(STEP)
            inside, spots = spots < k, np.minimum(spots, k - 1)
            here = at[live][:, None]
            entry = self.order[here, spots]
            near = inside & (self.apart[here, spots] <= 4 * best[live][:, None])
            row, col = np.nonzero(near & ~met[live[:, None], entry])
            new = entry[row, col]
            met[live[row], new] = True
            away = np.full(entry.shape, np.inf, best.dtype)
            away[row, col] = squared(parts[live[row]] - self.entries[new])
            low = away.min(axis=1)
            which = np.where((away == low[:, None]) & near, entry, k).min(axis=1)
            better = (low < best[live]) | ((low == best[live]) & (which < at[live]))
            at[live[better]], best[live[better]] = which[better], low[better]
            place[live] = np.where(better, 0, place[live] + STEP)
            live = live[better | near[:, -1]]
        return at, best


@dataclass
class Codebooks:
    """One array (entries, width) of whole numbers for each part position."""

    entries: list[np.ndarray]
    scale: int = SCALE

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.entries for x in book.ravel()).encode()).hexdigest()

    def assigned(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each vector's parts, both (vectors, parts)."""
        found = []
        for p, book in enumerate(self.entries):
            book, parts = exact(book, vectors[:, p * self.width : (p + 1) * self.width])
            lists = Book(book)
            found.append([np.concatenate(x) for x in zip(*(lists.nearest(parts[i : i + SIDE]) for i in range(0, max(1, len(parts)), SIDE)), strict=True)])
        at, best = zip(*found, strict=True)
        return np.stack(at, axis=1), np.stack([np.asarray(b, object) for b in best], axis=1)

    def decode(self, codes: DataFrame, code: str = "code") -> DataFrame:
        """``codes`` with a column ``decoded``: what the entries stand for, as doubles."""
        entries, scale = self.entries, self.scale

        def run(batches):
            for batch in batches:
                out = []
                for c in batch.column(batch.schema.get_field_index(code)).to_pylist():
                    raw = None if c is None else bytes.fromhex(c)
                    out.append(None if raw is None else np.concatenate([book[i] for book, i in zip(entries, raw, strict=True)]) / scale)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "decoded"])

        schema = StructType([*codes.schema.fields, StructField("decoded", ArrayType(DoubleType()))])
        return codes.mapInArrow(run, schema)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of a list column's rows, which are equally long; zeros follow up to ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, width))
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _sums(books: Codebooks):
    """What the entries' parts are together, and how many: one row for each entry that a task uses."""
    k, width, total = len(books.entries[0]), books.width, books.width * len(books.entries)

    def run(batches):
        sums = [np.zeros((k, width), object) for _ in books.entries]
        counts = [np.zeros(k, np.int64) for _ in books.entries]
        for batch in batches:
            for i in range(0, batch.num_rows, SIDE):
                vectors = scaled(_vectors(batch.column(0).slice(i, SIDE), total), books.scale)
                at, _ = books.assigned(vectors)
                for p in range(len(books.entries)):
                    for w in range(width):
                        more = np.bincount(at[:, p], vectors[:, p * width + w], k)
                        sums[p][:, w] += more.astype(np.int64)
                    counts[p] += np.bincount(at[:, p], minlength=k)
        part, entry = np.nonzero(np.array(counts))
        rows = [sums[p][e] for p, e in zip(part.tolist(), entry.tolist(), strict=True)]
        cols = [pa.array([Decimal(int(r[w])) for r in rows], pa.decimal128(38, 0)) for w in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(np.array(counts)[part, entry], pa.int64()), *cols], ["part", "entry", "n", *(f"s{w}" for w in range(width))])

    return run


def _codes(books: Codebooks):
    total = books.width * len(books.entries)

    def run(batches):
        for batch in batches:
            at, best = books.assigned(scaled(_vectors(batch.column(batch.num_columns - 1), total), books.scale))
            error = [min(LONGEST, int(x)) for x in best.sum(axis=1)] if len(best) else []
            code = [row.tobytes().hex() for row in at.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(error, pa.int64())], [*batch.schema.names[:-1], "code", "error"])

    return run


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is whole and finite, and as long as most are."""
    finite = table.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size(vector) > 0))
    lengths = finite.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return finite.where(F.size(vector) == (lengths["n"] if lengths else 0))


def fit(table: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``usable`` rows; None without any."""
    first = table.select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    width = -(-len(first[0].v) // parts)
    start = np.zeros((len(first), width * parts))
    start[:, : len(first[0].v)] = scaled(np.array([r.v for r in first]), scale)
    books = Codebooks([start[:, p * width : (p + 1) * width].copy() for p in range(parts)], scale)
    columns = [f"s{w}" for w in range(width)]
    schema = "part int, entry int, n long, " + ", ".join(f"{c} decimal(38,0)" for c in columns)
    for _ in range(rounds):
        sums = table.select(vector).mapInArrow(_sums(books), schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).collect()
        new = [book.copy() for book in books.entries]
        for r in sums:
            new[r.part][r.entry] = [int(r[c]) // r.n for c in columns]
        books = Codebooks(new, scale)
    return books


def encode(table: DataFrame, books: Codebooks, columns: list[str], vector: str = "embedding") -> DataFrame:
    """``columns`` of ``usable`` rows, with ``code`` (two hex digits a part) and ``error``."""
    schema = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in columns)
    return table.select(*columns, vector).mapInArrow(_codes(books), f"{schema}, code string, error long")


def vector_codes(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels together) and the digest of the final codebooks."""
    rows = usable(table.select("vec_id", "label", "embedding"))
    books = fit(rows)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = materialize(encode(rows, books, ["vec_id", "label"]))
    most = F.lit(LONGEST).cast("decimal(38,0)")
    labels = coded.groupBy(F.col("label").alias("same")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels
    joined = coded.join(labels, F.col("label").eqNullSafe(F.col("same")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_sql() -> str:
    """The query in DuckDB SQL, every part compared with every entry."""
    rounds = []
    for i in range(ROUNDS + 1):
        rounds.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, p, w, m % {ENTRIES} AS e, m // {ENTRIES} AS d
  FROM (SELECT x.r, x.p, any_value(x.w) AS w,
               min(CAST(list_inner_product(x.w, x.w) - 2 * list_inner_product(x.w, b.c) + list_inner_product(b.c, b.c) AS BIGINT) * {ENTRIES} + b.e) AS m
        FROM parts x JOIN b{i} b USING (p) GROUP BY x.r, x.p)),""")
        if i < ROUNDS:
            rounds.append(f"""
b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.c, b.c) AS c
  FROM b{i} b LEFT JOIN (
    SELECT p, e, list(floor_mean ORDER BY k) AS c
    FROM (SELECT p, e, k, CAST((s - ((s % n) + n) % n) // n AS DOUBLE) AS floor_mean
          FROM (SELECT p, e, k, sum(CAST(x AS BIGINT)) AS s, count(*) AS n
                FROM (SELECT p, e, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM a{i}) GROUP BY p, e, k))
    GROUP BY p, e) n USING (p, e)),""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS w FROM kept, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, w AS c FROM parts WHERE r <= {ENTRIES}),{"".join(rounds)}
book AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS k FROM b{ROUNDS})),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), book"""
