"""The record store over HTTP: paged reads, incremental reads, idempotent writes, as Python data sources.

A read asks for (unit, dev, signature, t0, tf) and goes on from the last
record's time, without those that it has had, until a page holds nothing new.
Partitions are time slices, so a long series is read by many tasks.  Retries
are bounded, with a new session (a new connection) for the last one; a page
that fails too often fails the task, and Spark runs it again.  With the
option ``pushdown`` bounds on t and fixed units, devices and signatures reach
the store.  ``fetched`` reads a table of readings
(which series, from when to when), ``fetched_blobs`` theirs as files.  Each buffer that
is put names its write, partition and place, so that a store can tell the
buffers of a task that ran again from new ones.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import json
import time
import urllib.request
import uuid
import zipfile
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

RECORD = "version string, unit bigint, value double, error int, confidence int, x double, y double, z double, t bigint, signature bigint, dev int"
FIELDS = [f.split()[0] for f in RECORD.split(", ")]
#: Records that a task holds before it hands them on.
BATCH = 1000


def post(url: str, body: dict, retries: int = 3, wait: float = 0.2) -> dict:
    """One request, tried again a bounded number of times."""
    data = json.dumps(body).encode()
    for k in range(retries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=30) as r:
                return json.loads(r.read() or b"{}")
        except OSError:
            if k + 1 == retries:
                raise
            time.sleep(wait * 2**k)
    raise RuntimeError("unreachable")


def pages(options: dict, t0: int, tf: int):
    """Records of a time range, page by page."""
    query = {k: int(options[k]) for k in ("unit", "dev", "signature") if k in options}
    at = lambda r: int(r.get("timestamp", r.get("t")))
    had: dict[str, int] = {}  # records of the time that is asked for again, and how often they came
    while t0 <= tf:
        found = post(options["url"] + "/get", {"series": query | {"t0": t0, "t1": tf}}, int(options.get("retries", 3))).get("series", [])
        again, new = dict(had), []
        for r in found:
            name = json.dumps(r, sort_keys=True)
            if again.get(name, 0):
                again[name] -= 1
            else:
                new.append(r)
        for r in new:
            yield tuple(r.get("timestamp" if f == "t" and "timestamp" in r else f) for f in FIELDS)
        if not found:
            return
        last = max(map(at, found))
        # A page of nothing new: all records of this time are known, and the next ones are asked for.
        had, t0 = ({}, last + 1) if not new else (Counter(json.dumps(r, sort_keys=True) for r in found if at(r) == last), last)


class Slice(InputPartition):
    def __init__(self, t0: int, tf: int):
        self.t0, self.tf = t0, tf


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        t0, tf = int(self.options["t0"]), int(self.options["tf"])
        step = int(self.options.get("slice", max(1, tf - t0 + 1)))
        return [Slice(t, min(tf, t + step - 1)) for t in range(t0, tf + 1, step)]

    def read(self, partition):
        yield from pages(self.options, partition.t0, partition.tf)


class _NarrowingReader(_Reader):
    """A reader that takes filters; Spark runs it only where ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters):  # noqa: N802
        """Narrows what is asked of the store; Spark applies all filters again, as a store may know none of them."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            value = getattr(f, "value", None)
            if name == "t" and isinstance(value, int):
                low = {"EqualTo": value, "GreaterThanOrEqual": value, "GreaterThan": value + 1}.get(type(f).__name__)
                high = {"EqualTo": value, "LessThanOrEqual": value, "LessThan": value - 1}.get(type(f).__name__)
                if low is not None:
                    self.options["t0"] = str(max(low, int(self.options["t0"])))
                if high is not None:
                    self.options["tf"] = str(min(high, int(self.options["tf"])))
            elif name in ("unit", "dev", "signature") and name not in self.options and isinstance(f, EqualTo) and isinstance(value, int):
                self.options[name] = str(value)
            yield f


class _StreamReader(DataSourceStreamReader):
    """Offsets are times: a batch reads from the last one's end to the store's newest record."""

    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self):
        return {"t": int(self.options.get("t0", 0))}

    def latestOffset(self):
        query = {k: int(self.options[k]) for k in ("unit", "dev", "signature") if k in self.options}
        newest = post(self.options["url"] + "/last", {"series": query}, int(self.options.get("retries", 3))).get("t")
        return {"t": int(newest) + 1 if newest is not None else int(self.options.get("t0", 0))}

    def partitions(self, start, end):
        return [Slice(start["t"], end["t"] - 1)] if end["t"] > start["t"] else []

    def read(self, partition):
        yield from pages(self.options, partition.t0, partition.tf)

    def commit(self, end):
        pass


class _Writer(DataSourceWriter):
    """Creates each device's series, then puts its records in buffers of a bounded length."""

    def __init__(self, options):
        self.options = dict(options)
        self.name = self.options.get("write", uuid.uuid4().hex)  # the same in all tasks, and when one runs again

    def write(self, rows):
        return self.put_all((row.asDict() for row in rows), f"{TaskContext.get().partitionId()}:")

    def put_all(self, rows, part_of):
        sent = 0
        most, url, retries = int(self.options.get("buffer", 1000)), self.options["url"], int(self.options.get("retries", 3))
        buffers: dict[tuple, list] = {}

        def flush(key):
            nonlocal sent
            part = buffers.pop(key, [])
            if part:
                ts = [r["t"] for r in part]
                post(url + "/create", {"series": {"unit": key[0], "dev": key[1], "signature": key[2], "t0": min(ts), "t1": max(ts)}}, retries)
                post(url + "/put", {"records": part, "batch": f"{self.name}:{part_of}{sent}"}, retries)
                sent += 1

        for r in rows:
            key = (r["unit"], r["dev"], r["signature"])
            buffers.setdefault(key, []).append(r)
            if len(buffers[key]) >= most:
                flush(key)
        for key in list(buffers):
            flush(key)
        return WriterCommitMessage()


class _StreamWriter(_Writer, DataSourceStreamWriter):
    """As the batch writer; a put bears the digest of its records, so that an epoch or a task that runs again puts the same ones once.

    With the option ``epochs`` the store is told when all tasks of an epoch
    have put, or not, by ``/commit`` and ``/abort``.
    """

    def write(self, rows):
        held = sorted((row.asDict() for row in rows), key=lambda r: json.dumps(r, sort_keys=True, default=str))
        self.name = hashlib.sha256(json.dumps(held, sort_keys=True, default=str).encode()).hexdigest()[:32]
        return self.put_all(held, "")

    def commit(self, messages, batch_id):
        self._tell("/commit", batch_id)

    def abort(self, messages, batch_id):
        self._tell("/abort", batch_id)

    def _tell(self, what, batch_id):
        if self.options.get("epochs", "").lower() == "true":
            post(self.options["url"] + what, {"epoch": batch_id}, int(self.options.get("retries", 3)))


class RecordStore(DataSource):
    """Options: url, unit, dev, signature, t0, tf, slice, retries, pushdown; for writes also buffer."""

    @classmethod
    def name(cls):
        return "record_store"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return (_NarrowingReader if self.options.get("pushdown", "").lower() == "true" else _Reader)(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return _StreamWriter(self.options)


def time_slices(df: DataFrame, step: int = 1_000_000) -> DataFrame:
    """One row per slice of (t0, tf) for blobs that are fetched second by second; an unfinished last slice is left out."""
    return df.where(F.col("tf") - F.col("t0") > step).withColumn("until", F.explode(F.sequence(F.col("t0") + step, F.col("tf") - 1, F.lit(step))))


def fetched(readings: DataFrame, url: str, slice: int | None = None, tasks: int | None = None, retries: int = 3) -> DataFrame:
    """The records of each reading (unit, dev, signature, t0, tf): all its columns, and the record in column ``record``.

    Readings are cut into slices of time and dealt to tasks by their hash, so
    that many tasks read a long one; a task that is lost asks for its slices
    again.  Readings with a null among these columns or an empty range give no
    rows; readings that repeat are fetched each on its own.  ``record.value``
    is a number or null, ``record.raw`` the value as text.
    """
    readings = _signed(readings)
    step = F.lit(slice).cast("long") if slice else F.col("tf") - F.col("t0") + 1
    whole = readings.where("unit is not null and dev is not null and signature is not null and t0 <= tf")
    parts = whole.withColumn("_from", F.explode(F.sequence(F.col("t0"), F.col("tf"), step))).withColumn("_until", F.least(F.col("_from") + step - 1, F.col("tf")))
    return _asked(parts, url, tasks, retries).drop("_from", "_until")


def _signed(readings: DataFrame) -> DataFrame:
    """The readings of run contexts call their signature ``sig``."""
    return readings if "signature" in readings.columns else readings.withColumnRenamed("sig", "signature")


def _asked(parts: DataFrame, url: str, tasks: int | None, retries: int) -> DataFrame:
    """``parts`` and the records from _from to _until, both included."""
    keys = ["unit", "dev", "signature", "_from", "_until"]
    fields = [*RECORD.split(", "), "raw string"]
    kind = T.StructType.fromDDL(", ".join(fields))
    schema = T.StructType([*parts.schema.fields, T.StructField("record", kind)])

    def run(batches):
        record = to_arrow_type(kind)
        for b in batches:
            asked = zip(*[b.column(k).to_pylist() for k in keys], strict=True)
            for i, (unit, dev, signature, start, end) in enumerate(asked):
                found = pages({"url": url, "unit": unit, "dev": dev, "signature": signature, "retries": retries}, start, end)
                while part := list(itertools.islice(found, BATCH)):
                    rows = [_typed(p) for p in part]
                    columns = b.take(pa.array([i] * len(rows))).columns
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, record)], [*b.schema.names, "record"])

    return parts.repartition(*([tasks] if tasks else []), F.xxhash64(*keys)).mapInArrow(run, schema)


def _typed(record: tuple) -> dict:
    r = dict(zip(FIELDS, record, strict=True))
    value = r["value"]
    r["raw"] = value if value is None or isinstance(value, str) else json.dumps(value)
    r["value"] = float(value) if isinstance(value, (int, float)) else None
    return r


def fetched_blobs(readings: DataFrame, url: str, step: int = 1_000_000, dev: int | None = 0, retries: int = 3) -> DataFrame:
    """Blobs of readings, asked for by slices of ``step``: measurement, name (measurement, time and signature) and blob, for ``files.write_blobs``.

    An unfinished last slice is left out, as in ``time_slices``; where slices
    meet, a record is read once.  ``dev`` takes the place of the readings' own,
    None leaves it.  Values that are no base64 text give no blob.
    """
    readings = _signed(readings)
    plan = time_slices(readings if dev is None else readings.withColumn("dev", F.lit(dev)), step).withColumnRenamed("until", "_until")
    start = F.col("_until") - step
    plan = plan.where("unit is not null and dev is not null and signature is not null").withColumn("_from", F.when(start > F.col("t0"), start + 1).otherwise(start))
    got = _asked(plan, url, None, retries)
    name = F.concat(F.col("measurement"), F.lit("-"), F.col("record.t").cast("string"), F.lit("_"), F.col("signature").cast("string"), F.lit(".raw"))
    return got.select("measurement", name.alias("name"), F.try_to_binary(F.col("record.raw"), F.lit("base64")).alias("blob")).where("blob is not null")


def first_context(contexts: DataFrame, order: str = "t") -> DataFrame:
    """The context that comes first in a series' order."""
    return contexts.orderBy(order).limit(1)


def zipped_contexts(series: DataFrame, value: str, commit: Column | str) -> DataFrame:
    """Run contexts out of zip archives in base64 text; archives are read in memory, failed builds and other commits are left out."""

    def run(batches):
        for b in batches:
            out, places = [], []
            for v, place in zip(b["zip"], b["place"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(base64.b64decode(v or ""))) as z:
                        texts = [z.read(n).decode("utf-8", "replace") for n in sorted(z.namelist()) if n.endswith(".json")]
                        out += texts
                        places += [place] * len(texts)
                except (zipfile.BadZipFile, ValueError):
                    continue
            yield pd.DataFrame({"context": pd.Series(out, dtype=object), "t": pd.Series(places, dtype="Int64")})

    place = F.col("t").cast("long") if "t" in series.columns else F.lit(None).cast("long")
    text = series.select(F.col(value).alias("zip"), place.alias("place")).mapInPandas(run, "context string, t long")
    return text.where(F.split(F.get_json_object("context", "$.id"), "\n")[0] == commit)
