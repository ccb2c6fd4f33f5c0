"""Embedding near-dedup by NN-descent.

Equal directions within a label are one point.  A neighbour graph starts from
a few random-hyperplane sorts, cut into small blocks that are compared in
full.  Then neighbours of neighbours are compared: each point gathers the
members of its list and its reverse list, in blocks, and a pair that meets
there, one of them new to the point, enters a list that it improves.  Rounds
work on sketches of one byte a component and go on until hardly any list
changes.  A list that is full of links is enlarged to twice its length.

Near the threshold and above it, pairs are confirmed in double precision; they
give components.  A point whose enlarged list is still full of links may have
links that found no place: such points are compared with those of other
components, in blocks whose bounding balls don't rule it out, so that dense
groups that touch are joined.  An audit compares sample points with all rows
of their label; if fewer than RECALL of their links lie inside components, all
points are compared in this way, which finds every link.

Links are then counted exactly inside components: members are ordered by
their angle to a pivot and cut into blocks, and block pairs whose bounding
balls prove that all or none of their pairs link are counted without
comparing; the rest is compared, inside tasks, so pairs are never listed.

Vectors that are null, zero, or hold null or non-finite components, and rows
with a null label, link with nothing: each is its own component.  Rows that
repeat a vec_id keep one row each; vectors are compared in double precision,
and only with others of the same length.  Equal similarities are ranked by
name.  Very long vectors only cost more.  An empty table gives an empty
result; columns beyond vec_id, label and embedding are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import connected_components, materialize, release

THRESHOLD = 0.93
NEIGHBOURS = 12
BLOCK = 256
SORTS = 3
MOST_ROUNDS = 6
AUDIT = 200
RECALL = 0.99
#: Rounds end when so small a share of the lists' places changes.
STILL = 0.001
#: Sketches are off by less than this for all but freak vectors; a link that they miss is the audit's and the dense groups' matter.
MARGIN = 0.02
#: Balls that are compared at once.
BALLS = 512
#: Slack of bounds in double precision.
EPS = 1e-9


def _unit_vectors(batches):
    """Points: a name of label and direction, the unit vector, and its sketch; null where a vector can't link."""
    for vid, label, emb in tv.rows(batches, ["vec_id", "label", "embedding"]):
        pid, unit, dim = [], [], []
        for lab, v in zip(label.to_pylist(), emb, strict=True):
            x = np.array([np.nan if c is None else c for c in v.as_py()], dtype=np.float64) if v.is_valid else np.zeros(0)
            scale = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            if lab is None or not scale > 0:
                pid.append(None)
                unit.append(None)
                dim.append(0)
                continue
            x = x / scale
            x = x / np.sqrt((x * x).sum()) + 0.0
            bits = x.tobytes()
            h = tv.mix(np.frombuffer(bits, np.uint64) ^ np.arange(1, len(x) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            name = tv.mix(np.array([np.add.reduce(h)]) ^ tv.mix(np.array([lab & 0xFFFFFFFF], dtype=np.uint64)))
            pid.append(int(name.view(np.int64)[0]))
            unit.append(bits)
            dim.append(len(x))
        yield pa.RecordBatch.from_arrays([vid, label.cast(pa.int64()), pa.array(pid, pa.int64()), pa.array(unit, pa.binary()), pa.array(dim, pa.int32())], ["vec_id", "label", "pid", "unit", "dim"])


def _rows(unit: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(unit.to_pylist()), np.float64).reshape(len(unit), -1)


def _code(bits: int, seed: int):
    """The side of each random hyperplane, as a number."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for pid, label, dim, unit in tv.rows(batches, ["pid", "label", "dim", "unit"]):
            d = dim.to_numpy()
            code = np.zeros(len(pid), np.int64)
            for k in np.unique(d).tolist():
                if k not in planes:
                    planes[k] = np.random.default_rng([seed, k]).standard_normal((k, bits))
                at = np.flatnonzero(d == k)
                side = _rows(unit.take(pa.array(at))) @ planes[k] > 0
                code[at] = side @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays([pid, label, dim, unit, pa.array(code)], ["pid", "label", "dim", "unit", "code"])

    return run


def _sketch(batches):
    """Unit vectors in one byte a component, with the step that a byte stands for."""
    for pid, label, dim, unit in tv.rows(batches, ["pid", "label", "dim", "unit"]):
        raw, step = [], []
        for u in unit:
            x = np.frombuffer(u.as_buffer(), np.float64)
            top = float(np.abs(x).max()) / 127
            raw.append(np.rint(x / top).astype(np.int8).tobytes())
            step.append(top)
        yield pa.RecordBatch.from_arrays([pid, label, dim, pa.array(raw, pa.binary()), pa.array(step, pa.float32())], ["pid", "label", "dim", "sketch", "step"])


SKETCH = "pid long, label long, dim int, sketch binary, step float"


def _similar(m) -> np.ndarray:
    """Similarities of all pairs of members, by their sketches."""
    sketch = m.field("sketch")
    x = np.frombuffer(b"".join(sketch.to_pylist()), np.int8).reshape(len(sketch), -1).astype(np.float32) * m.field("step").to_numpy()[:, None]
    return x @ x.T


def _edges(parts) -> pa.RecordBatch:
    u, v, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["u", "v", "s"])


EDGE = "u long, v long, s double"


def _met(k: int, local: bool):
    """For each member of a block the best k others; in a local join only pairs with a new member that improve a list."""

    def run(batches):
        for (members,) in tv.rows(batches, ["members"]):
            parts = []
            for m in members:
                m = m.values
                names = m.field("pid").to_numpy()
                if len(names) < 2:
                    continue
                sims = _similar(m)
                np.fill_diagonal(sims, -3)
                if local:
                    new = m.field("new").to_numpy(zero_copy_only=False)
                    sims[~(new[:, None] | new[None, :]) | (sims <= m.field("kth").to_numpy()[:, None])] = -3
                n = min(k, len(names) - 1)
                best = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                found = np.take_along_axis(sims, best, axis=1)
                row, at = np.nonzero(found > -3)
                parts.append((names[row], names[best[row, at]], found[row, at].astype(float)))
            yield _edges(parts)

    return run


def block_neighbours(points: DataFrame, sketches: DataFrame, k: int, seed: int) -> DataFrame:
    """Edges between points that fall into one block of a random-hyperplane sort.

    Cells are the sides of so many hyperplanes that a label's cells hold a
    block on average; larger cells are dealt by hash into blocks of that size.
    """
    dealt = cells(points, seed).join(sketches.select("pid", "sketch", "step"), "pid")
    blocks = dealt.groupBy("label", "dim", "code", "part").agg(F.collect_list(F.struct("pid", "sketch", "step")).alias("members"))
    return blocks.select("members").mapInArrow(_met(k, False), EDGE)


def cells(points: DataFrame, seed: int) -> DataFrame:
    """pid, label, dim and the cell (code, part) of each point."""
    most = points.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    bits = max(1, math.ceil(math.log2(max(2, most / BLOCK))))
    coded = points.mapInArrow(_code(bits, seed), "pid long, label long, dim int, unit binary, code long").drop("unit")
    sizes = coded.groupBy("label", "dim", "code").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    return coded.join(sizes, ["label", "dim", "code"]).withColumn("part", F.pmod(F.xxhash64("pid", F.lit(seed)), F.col("parts"))).drop("parts")


def best_lists(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k best neighbours of each point, 2 k where these are all links; ``kth`` is what a new one must exceed."""
    w = Window.partitionBy("u")
    ranked = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("new").alias("new")).withColumn("rank", F.row_number().over(w.orderBy(F.desc("s"), "v"))).where(F.col("rank") <= 2 * k)
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("s"))).over(w)
    full = F.coalesce(at(k) >= threshold - MARGIN, F.lit(False))
    ranked = ranked.withColumns({"full": full, "kth": F.coalesce(F.when(full, at(2 * k)).otherwise(at(k)), F.lit(-2.0))})
    return materialize(ranked.where((F.col("rank") <= k) | F.col("full")).select("u", "v", "s", "new", "kth"))


def descend(sketches: DataFrame, graph: DataFrame, k: int, threshold: float, turn: int) -> DataFrame:
    """One round: compare neighbours of neighbours, keep the best lists."""
    both = graph.select(F.col("u").alias("at"), F.col("v").alias("pid"), "new").union(graph.select(F.col("v").alias("at"), F.col("u").alias("pid"), "new"))
    met = both.groupBy("at", "pid").agg(F.max("new").alias("new"))
    # Only places that somebody new has come to; hubs meet in blocks, as many as their degree needs, dealt anew each round.
    place = met.groupBy("at").agg(F.count("*").alias("degree"), F.bool_or("new").alias("any")).where("any and degree > 1").drop("any")
    met = met.join(place, "at").withColumn("part", F.pmod(F.xxhash64("pid", "at", F.lit(turn)), F.ceil(F.col("degree") / (4 * k))))
    kth = graph.groupBy("u").agg(F.max("kth").alias("kth")).withColumnRenamed("u", "pid")
    info = sketches.select("pid", "sketch", "step").join(kth, "pid", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
    gathered = met.select("at", "part", "pid", "new").join(info, "pid").groupBy("at", "part").agg(F.collect_list(F.struct("pid", "new", "kth", "sketch", "step")).alias("members"))
    new = gathered.select("members").mapInArrow(_met(k, True), EDGE)
    return best_lists(graph.select("u", "v", "s", F.lit(False).alias("new")).union(new.withColumn("new", F.lit(True))), k, threshold)


def _confirm(threshold: float):
    def run(batches):
        for a, b, x, y in tv.rows(batches, ["a", "b", "ua", "ub"]):
            ok = pa.array(np.array([float(np.frombuffer(p.as_buffer(), np.float64) @ np.frombuffer(q.as_buffer(), np.float64)) for p, q in zip(x, y, strict=True)]) >= threshold)
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose similarity in double precision is at least the threshold."""
    of = lambda c: points.select(F.col("pid").alias(c), F.col("unit").alias(f"u{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ua", "ub").mapInArrow(_confirm(threshold), "a long, b long")


def _close(threshold: float):
    """Pairs of balls, of two groups of them, that may hold a link."""

    def run(batches):
        limit = math.acos(threshold)
        for i, j, members in tv.rows(batches, ["i", "j", "members"]):
            left, right = [], []
            for x, y, m in zip(i.to_pylist(), j.to_pylist(), members, strict=True):
                m = m.values
                group, names = m.field("group").to_numpy(), np.array(m.field("block").to_pylist(), object)
                c, radius = _rows(m.field("centre")), m.field("radius").to_numpy()
                p, q = np.flatnonzero(group == x), np.flatnonzero(group == y)
                angle = np.arccos(np.clip(c[p] @ c[q].T, -1, 1))
                near = angle - radius[p][:, None] - radius[q][None, :] <= limit + 1e-7
                if x == y:
                    near &= p[:, None] <= q[None, :]
                r, s = np.nonzero(near)
                left += names[p[r]].tolist()
                right += names[q[s]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])

    return run


def _bridge(threshold: float):
    """One link for each two components that link across two blocks."""

    def run(batches):
        for left, right in tv.rows(batches, ["lm", "rm"]):
            a, b = [], []
            for x, y in zip(left, right, strict=True):
                x, y = x.values, y.values
                cx, cy = x.field("comp").to_numpy(), y.field("comp").to_numpy()
                r, s = np.nonzero((_rows(x.field("unit")) @ _rows(y.field("unit")).T >= threshold) & (cx[:, None] != cy[None, :]))
                if len(r):
                    first = np.unique(np.stack([cx[r], cy[s]]), axis=1, return_index=True)[1]
                    a += x.field("pid").to_numpy()[r[first]].tolist()
                    b += y.field("pid").to_numpy()[s[first]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def bridges(placed: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """Links between different components, found by comparing blocks of points with each other.

    ``placed`` has pid, comp and key (which points lie near each other); blocks
    of a label meet unless their bounding balls rule out a link.
    """
    p = placed.join(points.select("pid", "label", "dim", "unit"), "pid")
    sizes = p.groupBy("label", "dim", "key").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    p = p.join(sizes, ["label", "dim", "key"]).withColumn("block", F.concat_ws(":", "label", "dim", "key", F.pmod(F.xxhash64("pid"), F.col("parts"))))
    blocks = materialize(p.groupBy("label", "dim", "block").agg(F.collect_list(F.struct("pid", "comp", "unit")).alias("members")))
    balls = blocks.withColumn("component", F.lit(0).cast("long")).mapInArrow(_members(threshold), "component long, block string, centre binary, radius double").drop("component")
    balls = materialize(balls.join(blocks.select("block", "label", "dim"), "block"))
    groups = balls.groupBy("label", "dim").agg(F.ceil(F.count("*") / BALLS).cast("int").alias("groups"))
    dealt = balls.join(groups, ["label", "dim"]).withColumn("group", F.pmod(F.xxhash64("block"), F.col("groups")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumns({"i": F.least("group", "other"), "j": F.greatest("group", "other")})
    met = dealt.groupBy("label", "dim", "i", "j").agg(F.collect_list(F.struct("group", "block", "centre", "radius")).alias("members"))
    pairs = met.select("i", "j", "members").mapInArrow(_close(threshold), "left string, right string")
    side = lambda c, m: blocks.select(F.col("block").alias(c), F.col("members").alias(m))
    out = materialize(pairs.join(side("left", "lm"), "left").join(side("right", "rm"), "right").select("lm", "rm").mapInArrow(_bridge(threshold), "a long, b long"))
    release(blocks, balls)
    return out


def audit(points: DataFrame, components: DataFrame, threshold: float, sample: int = AUDIT) -> tuple[int, int]:
    """(links of sample points, found by comparing them with all rows; how many of them lie inside one component).

    The queries are a fixed number of points and go to every task.
    """
    queries = points.orderBy(F.xxhash64("pid", F.lit(7)), "pid").limit(sample).select(F.col("pid").alias("q"), F.col("label").alias("ql"), F.col("dim").alias("qd"), F.col("unit").alias("qu")).toPandas()
    if not len(queries):
        return 0, 0
    groups = {key: (g.q.to_numpy(), np.stack([np.frombuffer(u, np.float64) for u in g.qu])) for key, g in queries.groupby(["ql", "qd"])}

    def run(batches):
        for pid, label, dim, unit in tv.rows(batches, ["pid", "label", "dim", "unit"]):
            parts = []
            labels, dims, names = label.to_numpy(), dim.to_numpy(), pid.to_numpy()
            for (lab, d), (q, x) in groups.items():
                at = np.flatnonzero((labels == lab) & (dims == d))
                if len(at):
                    i, j = np.nonzero(x @ _rows(unit.take(pa.array(at))).T >= threshold)
                    parts.append((q[i], names[at[j]], np.ones(len(i))))
            yield _edges(parts)

    truth = points.mapInArrow(run, EDGE).where("u <> v")
    c = components
    joined = truth.join(c.toDF("u", "cu"), "u", "left").join(c.toDF("v", "cv"), "v", "left")
    r = joined.agg(F.count("*").alias("n"), F.count(F.when(F.col("cu") == F.col("cv"), 1)).alias("found")).first()
    return r.n, r.found


def _members(threshold: float):
    """Blocks' balls: a centre and the largest angle to it."""

    def run(batches):
        for comp, block, members in tv.rows(batches, ["component", "block", "members"]):
            centres, radii = [], []
            for m in members:
                x = _rows(m.values.field("unit"))
                c = x.sum(axis=0)
                norm = np.sqrt((c * c).sum())
                c = c / norm if norm > EPS else x[0]
                centres.append(c.tobytes())
                radii.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()) + 1e-7)
            yield pa.RecordBatch.from_arrays([comp, block, pa.array(centres, pa.binary()), pa.array(radii, pa.float64())], ["component", "block", "centre", "radius"])

    return run


def _decide(threshold: float):
    """1 if all pairs of two blocks link, 0 if none does, null if they must be compared."""

    def run(batches):
        for comp, i, j, ci, cj, ri, rj in tv.rows(batches, ["component", "i", "j", "ci", "cj", "ri", "rj"]):
            a, b = _rows(ci), _rows(cj)
            angle = np.arccos(np.clip((a * b).sum(axis=1), -1, 1))
            reach = ri.to_numpy() + rj.to_numpy()
            limit = math.acos(threshold)
            all_, none = angle + reach < limit - 1e-7, angle - reach > limit + 1e-7
            sure = pa.array(np.where(all_, 1, 0), pa.int32(), mask=~(all_ | none))
            yield pa.RecordBatch.from_arrays([comp, i, j, sure], ["component", "i", "j", "sure"])

    return run


def _count_links(threshold: float):
    """Links between the members of two blocks: (pid, weighted number of links)."""

    def run(batches):
        for i, j, left, right in tv.rows(batches, ["i", "j", "left", "right"]):
            out = []
            for same, a, b in zip((x == y for x, y in zip(i.to_pylist(), j.to_pylist(), strict=True)), left, right, strict=False):
                a, b = a.values, b.values
                link = _rows(a.field("unit")) @ _rows(b.field("unit")).T >= threshold
                if same:
                    np.fill_diagonal(link, False)
                out.append((a.field("pid").to_numpy(), link @ b.field("copies").to_numpy()))
                if not same:
                    out.append((b.field("pid").to_numpy(), a.field("copies").to_numpy() @ link))
            pid, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int64()), pa.array(n, pa.int64())], ["pid", "n"])

    return run


def count_links(points: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """(pid, n): for each point of a component, the rows of other points that link with it."""
    m = points.join(components.toDF("pid", "component"), "pid")
    m = materialize(m.select("component", "pid", "unit", "copies"))
    sizes = m.groupBy("component").agg(F.count("*").alias("size"), F.min("pid").alias("pivot"))
    pivots = sizes.join(m.select(F.col("pid").alias("pivot"), F.col("unit").alias("pu")), "pivot").select("component", "size", "pu")

    def angle(batches):
        for comp, pid, unit, copies, size, pu in tv.rows(batches, ["component", "pid", "unit", "copies", "size", "pu"]):
            cos = np.array([float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) for x, y in zip(unit.to_pylist(), pu.to_pylist(), strict=True)])
            shell = np.floor(np.arccos(np.clip(cos, -1, 1)) / 0.04).astype(np.int64)
            yield pa.RecordBatch.from_arrays([comp, pid, unit, copies, size, pa.array(shell)], ["component", "pid", "unit", "copies", "size", "shell"])

    shells = m.join(pivots, "component").mapInArrow(angle, "component long, pid long, unit binary, copies long, size long, shell long")
    per = shells.groupBy("component", "shell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    # Small components are one block.
    placed = shells.join(per, ["component", "shell"])
    block = F.when(F.col("size") <= BLOCK, F.lit("0")).otherwise(F.concat_ws(".", "shell", F.pmod(F.xxhash64("pid"), F.col("parts"))))
    placed = placed.withColumn("block", block)
    blocks = materialize(placed.groupBy("component", "block").agg(F.collect_list(F.struct("pid", "unit", "copies")).alias("members")))
    weight = F.aggregate("members", F.lit(0).cast("long"), lambda a, x: a + x["copies"])
    balls = materialize(
        blocks.join(blocks.groupBy("component").agg(F.count("*").alias("blocks")).where("blocks > 1"), "component", "left_semi")
        .mapInArrow(_members(threshold), "component long, block string, centre binary, radius double")
        .join(blocks.select("component", "block", weight.alias("weight")), ["component", "block"])
    )
    a = balls.select("component", F.col("block").alias("i"), F.col("centre").alias("ci"), F.col("radius").alias("ri"))
    b = balls.select("component", F.col("block").alias("j"), F.col("centre").alias("cj"), F.col("radius").alias("rj"))
    pairs = materialize(a.join(b, "component").where("i <= j").mapInArrow(_decide(threshold), "component long, i string, j string, sure int"))
    both = pairs.where("sure = 1").select("component", F.col("i").alias("block"), F.col("j").alias("other"))
    both = both.union(both.where("block <> other").select("component", F.col("other"), F.col("block")))
    sums = both.join(balls.select("component", F.col("block").alias("other"), "weight"), ["component", "other"]).groupBy("component", "block").agg(F.sum("weight").alias("w"), F.max(F.col("block") == F.col("other")).alias("own"))
    sure = blocks.join(sums, ["component", "block"]).select(F.explode("members").alias("m"), "w", "own").select(F.col("m.pid").alias("pid"), (F.col("w") - F.when(F.col("own"), F.col("m.copies")).otherwise(0)).alias("n"))
    open_ = pairs.where("sure is null").select("component", "i", "j").union(blocks.join(balls, ["component", "block"], "left_anti").select("component", "block", "block"))
    left = blocks.select("component", F.col("block").alias("i"), F.col("members").alias("left"))
    right = blocks.select("component", F.col("block").alias("j"), F.col("members").alias("right"))
    compared = open_.join(left, ["component", "i"]).join(right, ["component", "j"]).select("i", "j", "left", "right").mapInArrow(_count_links(threshold), "pid long, n long")
    out = materialize(compared.union(sure).groupBy("pid").agg(F.sum("n").alias("n")))
    release(m, blocks, balls, pairs)
    return out


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``embeddings`` (vec_id, embedding, label)."""
    rows = materialize(embeddings.select("vec_id", "label", "embedding").mapInArrow(_unit_vectors, "vec_id long, label long, pid long, unit binary, dim int"))
    named = rows.where("pid is not null")
    points = materialize(named.groupBy("pid").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("first")))

    sketches = materialize(points.mapInArrow(_sketch, SKETCH))

    found = block_neighbours(points, sketches, k, 0)
    for seed in range(1, SORTS):
        found = found.union(block_neighbours(points, sketches, k, seed))
    graph = best_lists(found.withColumn("new", F.lit(True)), k, threshold)
    for turn in range(MOST_ROUNDS):
        new = descend(sketches, graph, k, threshold, turn)
        release(graph)
        graph = new
        changed = graph.agg(F.count_if("new").alias("new"), F.count("*").alias("n")).first()
        if changed.new <= STILL * changed.n:
            break
    near = graph.where(F.col("s") >= threshold - MARGIN)
    links = materialize(confirmed(near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), points, threshold))

    def joined(links: DataFrame) -> DataFrame:
        return materialize(connected_components(links).toDF("pid", "component"))

    def placed(components: DataFrame) -> DataFrame:
        return points.select("pid").join(components, "pid", "left").select("pid", F.coalesce("component", "pid").alias("comp"))

    components = joined(links)
    # Full lists may have left links out: to other dense components.
    dense = graph.where(F.col("kth") >= threshold - MARGIN).select(F.col("u").alias("pid")).distinct()
    more = bridges(placed(components).join(dense, "pid").withColumn("key", F.col("comp")), points, threshold)
    if more.limit(1).count():
        links = materialize(links.union(more))
        release(components)
        components = joined(links)
    truth, seen = audit(points, components, threshold)
    if seen < RECALL * truth:
        near_cells = cells(points, SORTS).select("pid", F.concat_ws(".", "code", "part").alias("key"))
        more = bridges(placed(components).join(near_cells, "pid"), points, threshold)
        release(components)
        components = joined(links.union(more))
    release(graph, sketches, links, more)
    counts = count_links(points, components, threshold)
    # From points to the smallest vec_id of each component.
    p = points.select("pid", "first", "copies").join(components.toDF("pid", "component"), "pid", "left").withColumn("component", F.coalesce("component", "pid"))
    low = p.groupBy("component").agg(F.min("first").alias("component_id"))
    p = p.join(low, "component").join(counts, "pid", "left").select("pid", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = materialize(rows.join(p, "pid", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ))
    release(rows, points, components, counts)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
