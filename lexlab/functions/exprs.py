"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexlab.constants import STRIP_CHARS

UINT32_MAX = 4294967295.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# hashing: md5-based so that Spark and any SQL engine agree bit for bit
# --------------------------------------------------------------------------
def seeded_md5(seed: int | str, key: str | Column) -> Column:
    """md5 hex of ``'<seed>:<key>'`` (the repeatable ordering key)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def hex8_to_long(hex_col: Column) -> Column:
    """First 8 hex digits of a hex string as a non-negative BIGINT."""
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("bigint")


def unit_interval(hex_col: Column) -> Column:
    """Map a hex digest to a double in [0, 1]."""
    return hex8_to_long(hex_col).cast("double") / F.lit(UINT32_MAX)


def py_unit(text: str) -> float:
    """Driver-side twin of ``unit_interval(md5(text))`` for bounded tables."""
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:8], 16) / UINT32_MAX


# --------------------------------------------------------------------------
# strings
# --------------------------------------------------------------------------
def strip_ws(c: str | Column) -> Column:
    """Trim every whitespace character Python's ``str.strip`` removes.

    Plain ``trim`` only removes U+0020; NBSP, tab etc. need the explicit set.
    """
    return F.btrim(col(c), F.lit(STRIP_CHARS))


def split_last(line: str | Column, delim: str) -> tuple[Column, Column, Column]:
    """(has_delimiter, head, tail) of ``line.rsplit(delim, 1)``, native only."""
    line = col(line)
    has = F.instr(line, delim) > 0
    tail = F.substring_index(line, delim, -1)
    head = F.left(line, F.length(line) - F.length(tail) - F.lit(len(delim)))
    return has, head, tail


def one_line(c: str | Column) -> Column:
    """Replace line breaks by a space (text -> one corpus line)."""
    return F.translate(col(c), "\r\n", "  ")


# --------------------------------------------------------------------------
# maps / label domains
# --------------------------------------------------------------------------
def map_literal(m: Mapping) -> Column:
    items = sorted(m.items(), key=lambda kv: str(kv[0]))
    return F.create_map(*[F.lit(x) for kv in items for x in kv])


def invert_map(m: Column) -> Column:
    """{k: v} -> {v: k} as an expression."""
    return F.map_from_arrays(F.map_values(m), F.map_keys(m))


# --------------------------------------------------------------------------
# score vectors
# --------------------------------------------------------------------------
def argmax(arr: str | Column) -> Column:
    """0-based index of the first maximum (NaN counts as greatest)."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, as the element of a one-element array."""
    return F.transform(F.array(value), use)[0]


def softmax(arr: str | Column) -> Column:
    """Max-shifted softmax of a double array.

    The maximum, the exponentials and their sum are each bound once, not
    worked out again per element."""
    def shares(e: Column) -> Column:
        return bound(F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x).alias("s")),
                     lambda t: F.transform(t["e"], lambda x: x / t["s"]))

    return bound(F.struct(col(arr).alias("a"), F.array_max(col(arr)).alias("m")),
                 lambda t: bound(F.transform(t["a"], lambda x: F.exp(x - t["m"])), shares))


def dot(a: str | Column, b: str | Column) -> Column:
    """Left-fold dot product of two equal-length arrays."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, v: acc + v)


def double_array(values: Sequence[float]) -> Column:
    """A bounded literal array<double> (constant-folded by Catalyst)."""
    return F.array(*[F.lit(float(v)) for v in values])


def scores_map(names: Sequence[str], probs: str | Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), col(probs))


def format_scores(m: str | Column, digits: int = 3) -> Column:
    """``'k: v.vvv, ...'`` for a map<string,double>."""
    fmt = f"%s: %.{digits}f"
    return F.array_join(
        F.transform(F.map_entries(col(m)),
                    lambda e: F.format_string(fmt, e["key"], e["value"])), ", ")


def safe_div(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den is 0 (ANSI-safe)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def half_up_pct2(part: Column, total: Column) -> Column:
    """round(100 * part / total, 2), half-up on the exact rational.

    Whole numbers of 38 digits throughout, so no table size overflows and every
    engine gives the same double; 0.0 when total is 0.
    """
    p, t = part.cast("decimal(38,0)"), total.cast("decimal(38,0)")
    up = (p * F.lit(20000) + t).cast("decimal(38,0)")
    down = (F.nullif(t, F.lit(0).cast("decimal(38,0)")) * F.lit(2)).cast("decimal(38,0)")
    whole = ((up - F.pmod(up, down)) / down).cast("bigint")
    return F.when(t == 0, F.lit(0.0)).otherwise(whole.cast("double") / F.lit(100.0))
