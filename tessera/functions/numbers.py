"""Numeric, bit and array kernels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")

# Comparison operators by name.
COMPARISONS = ["equal", "greater", "greaterEqual", "lower", "lowerEqual", "notEqual"]


def compare(value: Column, operator: Column | str, threshold: Column | int) -> Column:
    """value <operator> threshold, the operator given by name or by a column of names."""
    threshold = F.lit(threshold) if isinstance(threshold, int) else threshold
    made = [value == threshold, value > threshold, value >= threshold, value < threshold, value <= threshold, value != threshold]
    if isinstance(operator, str):
        return made[COMPARISONS.index(operator)]
    out = F
    for name, test in zip(COMPARISONS, made):
        out = out.when(operator == name, test)
    return out


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(INFINITY)


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(INFINITY))


def in_box(lat: Column, lon: Column, lat1: float, lat2: float, lon1: float, lon2: float) -> Column:
    """Closed box; its corners come in any order."""
    return lat.between(min(lat1, lat2), max(lat1, lat2)) & lon.between(min(lon1, lon2), max(lon1, lon2))


def power_limit(total: Column, current: Column, minimum: int, maximum: int, step: int, reserve: int) -> Column:
    """What may be drawn: clamped to [minimum, maximum], else floored to a step (towards minus infinity)."""
    usable = -total + current - F.lit(reserve)
    return F.when(usable < minimum, F.lit(minimum)).when(usable > maximum, F.lit(maximum)).otherwise((F.floor(usable / step) * step).cast("int"))


def fit(width: Column, height: Column, most_w: int, most_h: int) -> tuple[Column, Column]:
    """Dimensions scaled down to a boundary, width first, in whole-number arithmetic."""
    w = F.when(width > most_w, F.lit(most_w)).otherwise(width).cast("long")
    h = F.when(width > most_w, F.call_function("div", F.lit(most_w).cast("long") * height, width)).otherwise(height).cast("long")
    return (
        F.when(h > most_h, F.call_function("div", F.lit(most_h).cast("long") * w, h)).otherwise(w),
        F.when(h > most_h, F.lit(most_h).cast("long")).otherwise(h),
    )


def has_flag(c: Column, flag: int) -> Column:
    return c.bitwiseAND(F.lit(flag)) == flag


def set_flag(c: Column, flag: int, on: bool = True) -> Column:
    return c.bitwiseOR(F.lit(flag)) if on else c.bitwiseAND(F.lit(~flag))


def band(c: Column, bounds: list[int]) -> Column:
    """Number of bounds that are reached."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(c >= b, 1).otherwise(0)
    return out


def rotations(a: Column) -> Column:
    """All rotations of an array, the array itself first."""
    n = F.size(a)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.slice(a, k + 1, n - k), F.slice(a, F.lit(1), k)))


def is_rotation_of(a: Column, b: Column) -> Column:
    """Whether b is a rotation of a; arrays of different lengths are an error."""
    return F.when(F.size(a) == F.size(b), F.array_contains(rotations(a), b)).otherwise(F.raise_error(F.lit("arrays differ in length")))


def bit_difference(a: Column, b: Column) -> Column:
    """Share of differing bits of two hexadecimal texts of equal length."""
    n = F.length(a)
    bits = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.bit_count(F.conv(F.substr(a, i, F.lit(1)), 16, 10).cast("int").bitwiseXOR(F.conv(F.substr(b, i, F.lit(1)), 16, 10).cast("int"))),
    )
    return F.aggregate(bits, F.lit(0), lambda acc, x: acc + x) / (n * 4)


# ------------------------------------------------------------------ 8-bit floats: sign, 3 exponent, 4 mantissa bits, bias 3


def let(value: Column, body) -> Column:
    """body(value) with value computed once: nested expressions stay small."""
    return F.get(F.transform(F.array(value), body), 0)


def minifloat_decode(code: Column) -> Column:
    return let(code.cast("int"), _decoded)


def _decoded(code: Column) -> Column:
    exponent = F.shiftright(code, 4).bitwiseAND(F.lit(7))
    mantissa = code.bitwiseAND(F.lit(15)).cast("double")
    size = (
        F.when(exponent == 0, mantissa / 64)
        .when((exponent == 7) & (mantissa != 0), F.lit(float("nan")))
        .when(exponent == 7, F.lit(INFINITY))
        .otherwise((1 + mantissa / 16) * F.pow(F.lit(2.0), exponent - 3))
    )
    return F.when(code.bitwiseAND(F.lit(128)) != 0, -size).otherwise(size)


def minifloat_encode(value: Column) -> Column:
    """The mantissa is cut, not rounded; over 15.5 is infinity, under 1/64 zero, NaN 0x7F."""
    return let(value.cast("double"), _encoded)


def _encoded(value: Column) -> Column:
    v = F.abs(value)
    sign = F.when(value < 0, 128).otherwise(0)
    code = F.when(v > 15.5, 7 * 16).when(v < 1 / 64, 0).when(v < 0.25, F.floor(v * 64).cast("int"))
    for exponent in range(1, 7):  # powers of two are compared exactly; no logarithm is rounded
        low = 2.0 ** (exponent - 3)
        code = code.when(v < 2 * low, exponent * 16 + F.floor((v / low - 1) * 16).cast("int"))
    return F.when(F.isnan(value), F.lit(0x7F)).otherwise(code + sign).cast("int")


def minifloat_add(a: Column, b: Column) -> Column:
    return minifloat_encode(minifloat_decode(a) + minifloat_decode(b))


def minifloat_bits(code: Column) -> Column:
    return F.lpad(F.bin(code.cast("long")), 8, "0")


def minifloat_parse(bits: Column) -> Column:
    """Bit text, padded with zeros on the right and cut to eight."""
    return F.conv(F.rpad(F.substring(bits, 1, 8), 8, "0"), 2, 10).cast("int")


# ------------------------------------------------------------------ coded values

# Fixed values.
AC_LINE = {0: "Offline", 1: "Online"}
ECC = {0: "Reserved", 1: "Other", 2: "Unknown", 3: "None", 4: "Parity", 5: "Single-bit ECC", 6: "Multi-bit ECC", 7: "CRC"}
BATTERY = {0: "normal", 1: "high", 2: "low", 4: "critical", 8: "charging", 128: "no battery"}


def decode(c: Column, codes: dict[int, str], default: str = "Unknown") -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c.cast("int")), F.lit(default))
