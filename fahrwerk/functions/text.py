"""Sniffer logs: sanitation, entries, and the repair of pseudo-JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what begins an entry; its unit text follows in braces.
START = "(u={"
VECTORS = "array<struct<id: bigint, class: int, lat: bigint, lon: bigint, alt: bigint, speed: double, heading: double, yawr: double, accel: double>>"


def repaired_json(text: Column) -> Column:
    """Single quotes become double ones, and ``key=`` becomes ``"key":``."""
    return F.regexp_replace(F.replace(text, F.lit("'"), F.lit('"')), r"(\w+)=", '"$1":')


def sanitized(text: Column) -> Column:
    """The log up to the entry that the first ``.-9`` spoils; whole where there is none, or no entry before it."""
    bad = F.instr(text, ".-9")
    head = F.substring(text, F.lit(1), bad - 1)
    last = F.instr(F.reverse(head), START[::-1])
    return F.when((bad == 0) | (last == 0), text).otherwise(F.substring(head, F.lit(1), F.length(head) - last - len(START) + 1))


def _entry(part: Column) -> Column:
    """What a part of a log holds, and whether it is an entry: all fields are whole numbers, and the body ends."""
    head = F.substring_index(part, "={", 1)
    fields = F.str_to_map(F.concat(F.lit("unit="), F.rtrim(F.substring_index(head, "=>", -1), F.lit(")"))), F.lit(","), F.lit("="))
    unit, dev, t, signature = (fields[n].try_cast("long") for n in ("unit", "d", "t", "sig"))
    body = F.substring(part, F.length(head) + 3, F.length(part))
    plain = F.substring_index(body, "}", 1)
    # A bracket before the first brace that closes begins a list, which holds braces itself.
    listed = F.contains(plain, F.lit("["))
    items = F.substring_index(F.substring_index(body, "]", 1), "[", -1)
    after = F.substring(body, F.instr(body, "]") + 1, F.lit(1))
    ends = F.when(listed, F.contains(body, F.lit("]")) & (after == "}")).otherwise(F.contains(body, F.lit("}")))
    # A comma before the end of a list has nothing after it.
    vectors = repaired_json(F.concat(F.lit("["), F.regexp_replace(F.trim(items), r",\s*$", ""), F.lit("]")))
    return F.struct(
        (ends & unit.isNotNull() & dev.isNotNull() & t.isNotNull() & signature.isNotNull()).alias("whole"),
        unit.alias("unit"),
        dev.cast("int").alias("dev"),
        t.alias("t"),
        signature.alias("signature"),
        F.when(~listed, F.nullif(F.trim(plain), F.lit("")).try_cast("double")).alias("value"),
        F.when(listed, F.from_json(vectors, VECTORS)).alias("value_mv"),
    )


def log_entries(logs: DataFrame, text: str = "text") -> DataFrame:
    """One row per entry of whole logs: pos, unit, dev, t, signature, value or value_mv.

    A log is cut where entries begin.  In each part ``=`` and a brace divide
    the fields from the body.  The number behind the arrow is the unit; d, t
    and sig are named fields, between commas.  The body ends with the first
    brace that closes it: a number or blank, or a list in brackets.  Parts
    whose fields aren't all whole numbers, or whose body doesn't end, are skipped.
    """
    parts = F.split(F.element_at(F.split(sanitized(F.col(text)), "Log Start:\n", 2), -1), r"\(u=\{")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    entries = F.filter(F.transform(parts, _entry), lambda e: e["whole"])
    kept = [c for c in logs.columns if c != text]
    return logs.select(*kept, F.posexplode(entries).alias("pos", "entry")).select(*kept, "pos", *[f"entry.{c}" for c in ("unit", "dev", "t", "signature", "value", "value_mv")])
