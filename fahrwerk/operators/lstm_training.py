"""Training of LSTM autoencoders, one for each group, on windows that Spark deals out.

A model is a stack of LSTM layers that narrow and widen again; each gives its
whole sequence of states to the next, and the last one's states are the
window again.  The loss is the mean squared error over windows scaled to 0 to 1
by their group's bounds.

A group's windows are dealt by a hash into shards of at most about
``shard_windows``.  In every epoch each shard goes once through its windows by
mini-batches with Adam, from the group's weights; the shards' weights and
moments are then averaged, by their numbers of windows, in steps that each take
at most FAN of them.  A group that fits into one shard is so trained by plain
Adam, and no task holds more than a shard, however large a group is.  Only the
weights of each group pass through the driver.

The learning rate halves after ``halve_after`` epochs without a better loss on
the validation windows, training ends after ``stop_after`` of them, and the best
weights stay.  Windows lie in a shard in the order of their keys and are mixed
by a seeded permutation, so that equal tables give equal models in any
partitioning.

Groups with fewer than ``least`` windows get no model.  Windows with nulls or
non-finite values are left out.  A signal that doesn't vary in a group scales
to 0.  An empty table gives no models.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = (128, 64, 32)
#: Models of shards that are averaged in one step.
FAN = 16
GATES = 4


def layer_sizes(signals: int, hidden: tuple[int, ...] = HIDDEN) -> list[tuple[int, int]]:
    """(inputs, states) of the layers: down to the last of ``hidden`` and back."""
    way = [signals, *hidden, *hidden[-2::-1], signals]
    return list(zip(way[:-1], way[1:], strict=True))


def initial(sizes: list[tuple[int, int]], seed: int = 42) -> list[dict]:
    """Weights drawn evenly within one by the root of the states."""
    rng = np.random.default_rng(seed)
    draw = lambda n, *shape: rng.uniform(-(n**-0.5), n**-0.5, shape)
    return [{"ih": draw(n, GATES * n, d), "hh": draw(n, GATES * n, n), "b": draw(n, GATES * n)} for d, n in sizes]


def flat(layers: list[dict]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for w in layers for k in ("ih", "hh", "b")])


def shaped(vector: np.ndarray, sizes: list[tuple[int, int]]) -> list[dict]:
    """Views of a vector as the layers' arrays."""
    out, at = [], 0
    for d, n in sizes:
        layer = {}
        for k, shape in (("ih", (GATES * n, d)), ("hh", (GATES * n, n)), ("b", (GATES * n,))):
            size = int(np.prod(shape))
            layer[k] = vector[at : at + size].reshape(shape)
            at += size
        out.append(layer)
    return out


def _bend(z: np.ndarray) -> None:
    """The sigmoid, in place."""
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    np.reciprocal(z, out=z)


def forward(x: np.ndarray, layers: list[dict]) -> tuple[np.ndarray, list]:
    """What the stack gives for windows (windows, steps, signals), and what the way back needs.

    Inside, time comes first, so that each step's gates lie together and are bent in one go.
    """
    kept, x = [], np.ascontiguousarray(x.transpose(1, 0, 2))
    for w in layers:
        n = w["hh"].shape[1]
        gates = x @ w["ih"].T + w["b"]
        states, cells, bent = (np.zeros((len(x) + k, x.shape[1], n), x.dtype) for k in (1, 1, 0))
        hh, moved = np.ascontiguousarray(w["hh"].T), np.empty_like(gates[0])
        for t, z in enumerate(gates):
            z += np.matmul(states[t], hh, out=moved)
            # Also the cell's gate: tanh(x) = 2 sigmoid(2 x) - 1, which costs a third of it.
            g = z[:, 2 * n : 3 * n]
            g *= 2
            _bend(z)
            g *= 2
            g -= 1
            np.multiply(z[:, n : 2 * n], cells[t], out=cells[t + 1])
            cells[t + 1] += z[:, :n] * g
            b = np.multiply(cells[t + 1], 2, out=bent[t])
            _bend(b)
            b *= 2
            b -= 1
            np.multiply(z[:, 3 * n :], bent[t], out=states[t + 1])
        kept.append((x, gates, states, cells, bent))
        x = states[1:]
    return x.transpose(1, 0, 2), kept


def gradients(layers: list[dict], kept: list, error: np.ndarray) -> list[dict]:
    """Derivatives of a loss by all weights, from those by the stack's output: back through layers and time."""
    found, error = [], error.transpose(1, 0, 2)
    for w, (x, gates, states, cells, bent) in zip(reversed(layers), reversed(kept), strict=True):
        n = w["hh"].shape[1]
        i, f, g, o = (gates[:, :, k * n : (k + 1) * n] for k in range(GATES))
        # What doesn't hang on later steps, for all steps at once.
        by_cell = np.stack([g * i * (1 - i), cells[:-1] * f * (1 - f), i * (1 - g * g)], axis=2)
        by_state, into_cell = bent * o * (1 - o), o * (1 - bent * bent)
        back = np.empty((*gates.shape[:2], GATES, n), x.dtype)
        dh = np.zeros_like(cells[0])
        dc, part = np.zeros_like(dh), np.empty_like(dh)
        for t in range(len(x) - 1, -1, -1):
            dh += error[t]
            dc += np.multiply(dh, into_cell[t], out=part)
            np.multiply(dc[:, None], by_cell[t], out=back[t, :, :3])
            np.multiply(dh, by_state[t], out=back[t, :, 3])
            np.matmul(back[t].reshape(-1, GATES * n), w["hh"], out=dh)
            dc *= f[t]
        rows = back.reshape(-1, GATES * n)
        found.append({"ih": rows.T @ x.reshape(-1, x.shape[2]), "hh": rows.T @ states[:-1].reshape(-1, n), "b": rows.sum(axis=0)})
        error = (rows @ w["ih"]).reshape(x.shape)
    return found[::-1]


@dataclass
class State:
    """Weights of a model on the way, and Adam's moments."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    rate: float = 1e-3

    def descend(self, grad: np.ndarray) -> None:
        self.steps += 1
        self.first += 0.1 * (grad - self.first)
        self.second += 0.001 * (grad * grad - self.second)
        self.weights -= self.rate * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)


def epoch(state: State, x: np.ndarray, sizes: list[tuple[int, int]], batch: int, seed: int) -> float:
    """One way through the windows; returns the sum of their losses on the way."""
    order, total = np.random.default_rng(seed).permutation(len(x)), 0.0
    layers = shaped(state.weights, sizes)
    for k in range(0, len(x), batch):
        own = x[order[k : k + batch]]
        out, kept = forward(own, layers)
        away = out - own
        total += float((away * away).mean()) * len(own)
        state.descend(flat(gradients(layers, kept, 2 * away / away.size)))
    return total


@dataclass
class Models:
    """Weights and bounds of each group's model, and how its training went."""

    signals: int
    hidden: tuple[int, ...]
    weights: dict = field(default_factory=dict)
    low: dict = field(default_factory=dict)
    high: dict = field(default_factory=dict)
    losses: dict = field(default_factory=dict)

    @property
    def sizes(self) -> list[tuple[int, int]]:
        return layer_sizes(self.signals, self.hidden)

    def arrays(self) -> dict[str, np.ndarray]:
        """All as named arrays, for ``files.save_arrays``."""
        out = {"hidden": np.array(self.hidden), "signals": np.array([self.signals])}
        for g in self.weights:
            out |= {f"weights/{g}": self.weights[g], f"low/{g}": self.low[g], f"high/{g}": self.high[g]}
        return out

    @staticmethod
    def of(arrays: dict[str, np.ndarray]) -> Models:
        """The models that ``arrays`` gave, as ``files.load_arrays`` reads them."""
        out = Models(int(arrays["signals"][0]), tuple(int(n) for n in arrays["hidden"]))
        for name, value in arrays.items():
            kind, _, group = name.partition("/")
            if group:
                getattr(out, kind)[group] = value
        return out

    def scaled(self, group: str, x: np.ndarray) -> np.ndarray:
        span = self.high[group] - self.low[group]
        return np.where(span > 0, (x - self.low[group]) / np.where(span > 0, span, 1), 0.0)


def _matrix(column, signals: int) -> np.ndarray:
    """Windows (windows, steps, signals) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1, signals)


def _bounds(signals: int):
    def run(batches):
        for batch in batches:
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            x = _matrix(batch.column(1), signals)
            for g in np.unique(groups):
                own = x[groups == g]
                yield pa.RecordBatch.from_arrays([pa.array([g] * signals, pa.string()), pa.array(range(signals), pa.int32()), pa.array(own.min(axis=(0, 1))), pa.array(own.max(axis=(0, 1)))], ["grp", "signal", "low", "high"])

    return run


_STATE = "grp string, shard long, n long, loss double, held_n long, held_loss double, steps long, weights binary, first binary, second binary"


def _row(group, shard, n, loss, held_n, held_loss, state: State) -> dict:
    return {"grp": group, "shard": shard, "n": n, "loss": loss, "held_n": held_n, "held_loss": held_loss, "steps": state.steps, "weights": state.weights.tobytes(), "first": state.first.tobytes(), "second": state.second.tobytes()}


def _table(rows: list[dict]) -> pa.Table:
    types = {"grp": pa.string(), "loss": pa.float64(), "held_loss": pa.float64(), "weights": pa.binary(), "first": pa.binary(), "second": pa.binary()}
    names = [c.split()[0] for c in _STATE.split(", ")]
    return pa.table([pa.array([r[n] for r in rows], types.get(n, pa.int64())) for n in names], names)


def _trained(models: Models, states, batch: int, number: int, train: bool):
    """An epoch of a shard from its group's weights, and the loss of those on its validation windows."""
    sizes, signals = models.sizes, models.signals

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run_id", "ascending"), ("seq", "ascending")])
        group, shard = table["grp"][0].as_py(), table["shard"][0].as_py()
        began = states.value.get(group)
        if began is None:  # its training has ended
            return _table([])
        x = models.scaled(group, _matrix(table["v"], signals))
        part = table["part"].to_numpy()
        held = x[part == "validation"]
        loss = 0.0
        for k in range(0, len(held), 1024):
            away = forward(held[k : k + 1024], shaped(began.weights, sizes))[0] - held[k : k + 1024]
            loss += float((away * away).mean(axis=(1, 2)).sum())
        state = State(began.weights.copy(), began.first.copy(), began.second.copy(), began.steps, began.rate)
        own = x[part == "train"]
        total = epoch(state, own, sizes, batch, 1_000_003 * number + shard) if train else 0.0
        return _table([_row(group, shard, len(own), total, len(held), loss, state)])

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """One model of several, weighted by their numbers of windows."""
    rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
    n = sum(r["n"] for r in rows)
    mean = lambda k: sum(np.frombuffer(r[k]) * (r["n"] / n if n else 1 / len(rows)) for r in rows)
    state = State(mean("weights"), mean("first"), mean("second"), max(r["steps"] for r in rows))
    total = lambda k: sum(r[k] for r in rows)
    return _table([_row(rows[0]["grp"], rows[0]["shard"] // FAN, n, total("loss"), total("held_n"), total("held_loss"), state)])


def fit(windows: DataFrame, signals: int, hidden: tuple[int, ...] = HIDDEN, epochs: int = 100, batch: int = 64, rate: float = 1e-3, halve_after: int = 10, stop_after: int = 20, least: int = 100, shard_windows: int = 20_000, seed: int = 42) -> Models:
    """Models of windows (grp, run_id, seq, v, part): v has the signals side by side in time, part is train, validation or test.

    A group's bounds are those of all its windows.
    """
    usable = windows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))).select("grp", "run_id", "seq", "v", "part")
    counts = {r.grp: (r.all, r.train) for r in usable.groupBy("grp").agg(F.count("*").alias("all"), F.count_if(F.col("part") == "train").alias("train")).collect() if r.grp is not None}
    wide = {g: max(1, -(-train // shard_windows)) for g, (every, train) in counts.items() if every >= least and train}
    models = Models(signals, hidden)
    if not wide:
        return models
    for r in usable.where(F.col("grp").isin(list(wide))).select("grp", "v").mapInArrow(_bounds(signals), "grp string, signal int, low double, high double").groupBy("grp", "signal").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        models.low.setdefault(r.grp, np.zeros(signals))[r.signal] = r.low
        models.high.setdefault(r.grp, np.zeros(signals))[r.signal] = r.high
    shards = F.create_map(*[F.lit(x) for g, n in wide.items() for x in (g, n)])
    dealt = usable.where(F.col("grp").isin(list(wide)) & F.col("part").isin("train", "validation"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("run_id", "seq"), shards[F.col("grp")]).cast("long"))
    # Each epoch reads the shards; lost ones are made again from the windows.
    dealt = dealt.repartition("grp", "shard").persist(StorageLevel.DISK_ONLY)
    sizes = models.sizes
    begin = flat(initial(sizes, seed))
    going = {g: State(begin.copy(), np.zeros_like(begin), np.zeros_like(begin), 0, rate) for g in wide}
    best, waited = {g: (np.inf, begin) for g in wide}, dict.fromkeys(wide, 0)
    spark = windows.sparkSession
    try:
        for number in range(epochs + 1):
            sent = spark.sparkContext.broadcast(going)
            done = dealt.groupBy("grp", "shard").applyInArrow(_trained(models, sent, batch, number, number < epochs), _STATE)
            few = max(wide.values())
            while few > 1:
                done = done.groupBy("grp", F.floor(F.col("shard") / FAN).cast("long").alias("of")).applyInArrow(_averaged, _STATE)
                few = -(-few // FAN)
            rows = done.collect()
            sent.destroy()
            for r in rows:
                g, state = r.grp, going[r.grp]
                loss = r.held_loss / r.held_n if r.held_n else np.inf
                models.losses.setdefault(g, []).append(loss)
                if loss < best[g][0]:
                    best[g], waited[g] = (loss, state.weights), 0
                else:
                    waited[g] += 1
                    if waited[g] % (halve_after + 1) == 0:
                        state.rate /= 2
                if waited[g] >= stop_after or number == epochs:
                    models.weights[g] = best[g][1] if r.held_n else state.weights
                    del going[g]
                else:
                    going[g] = State(*(np.frombuffer(x).copy() for x in (r.weights, r.first, r.second)), r.steps, state.rate)
            if not going:
                break
    finally:
        dealt.unpersist()
    return models


def errors(windows: DataFrame, models: Models, middle: bool = False) -> DataFrame:
    """``windows`` (with grp and v) and ``error``: the mean absolute error of each signal over the window, or that of its middle row.

    Errors are in the scale of the bounds.  Null where the group has no model
    or the window holds nulls or non-finite values.
    """
    sizes, signals = models.sizes, models.signals

    def run(batches):
        for batch in batches:
            groups = batch.column(batch.schema.get_field_index("grp")).to_pylist()
            column = batch.column(batch.schema.get_field_index("v"))
            out: list = [None] * batch.num_rows
            for g in {x for x in groups if x in models.weights}:
                own = [i for i, x in enumerate(groups) if x == g]
                raw = column.take(pa.array(own))
                full = [k for k, v in enumerate(raw) if v.is_valid and v.values.null_count == 0]
                x = _matrix(raw.take(pa.array(full, pa.int64())), signals).astype(float) if full else np.zeros((0, 1, signals))
                good = np.isfinite(x).all(axis=(1, 2))
                x = models.scaled(g, x[good])
                away = np.abs(x - forward(x, shaped(models.weights[g], sizes))[0])
                found = away[:, away.shape[1] // 2] if middle else away.mean(axis=1)
                for k, e in zip(np.array(full, int)[good].tolist(), found.tolist(), strict=True):
                    out[own[k]] = e
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "error"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*windows.schema.fields, StructField("error", ArrayType(DoubleType()))])
    return windows.mapInArrow(run, schema)
