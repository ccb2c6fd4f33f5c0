"""Packed 32-bit units of measurement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (field, lowest bit, bits) of both encodings; bit 31 tells which one.
DIGITAL = [("length", 0, 16), ("subtype", 16, 8), ("type", 24, 5), ("multi", 29, 2)]
SI = [("cd", 0, 3), ("mol", 3, 3), ("k", 6, 3), ("a", 9, 3), ("s", 12, 3), ("kg", 15, 3), ("m", 18, 3), ("rad", 21, 3), ("sr", 24, 3), ("mod", 8, 8)]
SI_FLAG = 1 << 31


def bits(unit: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(unit, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def decode_unit(unit: Column) -> Column:
    """All fields; those of the other encoding are 0."""
    si = bits(unit, 31, 1)
    fields = [si.alias("si")]
    fields += [F.when(si == 1, bits(unit, low, n)).otherwise(0).alias(name) for name, low, n in SI]
    fields += [F.when(si == 0, bits(unit, low, n)).otherwise(0).alias(name) for name, low, n in DIGITAL]
    return F.struct(*fields)


def _encode(layout, values: dict[str, Column]) -> Column:
    out = F.lit(0).cast("long")
    for name, low, n in layout:
        if name in values:
            field = values[name].cast("long").bitwiseAND(F.lit((1 << n) - 1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(field, low))
    return out


def encode_digital(**values: Column) -> Column:
    return _encode(DIGITAL, values)


def encode_si(**values: Column) -> Column:
    """Modifier and length share bits with exponents, as the format has it."""
    return _encode([*SI, ("length", 0, 8)], values).bitwiseOR(F.lit(SI_FLAG).cast("long"))


def is_multi(unit: Column) -> Column:
    return (bits(unit, 31, 1) == 0) & (bits(unit, 29, 2) > 0)
