"""Column functions over names and numbers with units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit letters by power.
UNITS = "kMGT"


def chop(s: Column) -> Column:
    """Without the last character."""
    return F.substring(s, F.lit(1), F.char_length(s) - 1)


def chomp(s: Column, end: str = "\n") -> Column:
    """Without one character ``end`` at the end, if it is there."""
    return F.when(F.endswith(s, F.lit(end)), chop(s)).otherwise(s)


def starts_with(s: Column, prefix: str) -> Column:
    """Whether ``s`` starts with ``prefix`` and is longer."""
    return F.startswith(s, F.lit(prefix)) & (F.char_length(s) > len(prefix))


def ends_with(s: Column, suffix: str) -> Column:
    """Whether ``s`` ends with ``suffix`` and is longer."""
    return F.endswith(s, F.lit(suffix)) & (F.char_length(s) > len(suffix))


def is_read_pair(a: Column, b: Column) -> Column:
    """Whether two names are equal, or one stem with /1 and /2."""
    return (a == b) | (ends_with(a, "/1") & ends_with(b, "/2") & (chop(a) == chop(b)))


def _plain(n: Column, places: int) -> Column:
    """``n`` / 10 ** places without trailing zeros."""
    if not places:
        return n.cast("string")
    rest = F.regexp_replace(F.lpad((n % 10**places).cast("string"), places, "0"), "0+$", "")
    whole = F.floor(n / 10**places).cast("bigint").cast("string")
    return F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest))


def significant(x: Column, digits: int) -> Column:
    """``x`` of at least 0 with up to four significant digits, as C prints it with %g.

    From 1 up the exact binary value is rounded, ties to even: its fraction is a whole
    number of 2 ** -52. Below 1 the shortest decimal form is rounded.
    """
    # The lambda binds the value, so generated code does not repeat its expression.
    return F.get(F.transform(F.array(x.cast("double")), lambda v: _significant(v, digits)), F.lit(0))


def _significant(x: Column, digits: int) -> Column:
    whole = F.floor(x).cast("bigint")
    bits = ((x - F.floor(x)) * float(1 << 52)).cast("bigint")
    out = F.lit(None).cast("string")
    for e in range(digits):
        scale = 10 ** (digits - 1 - e)
        part = bits * scale
        n = whole * scale + F.shiftright(part, 52)
        rest, half = part.bitwiseAND((1 << 52) - 1), 1 << 51
        n = n + F.when((rest > half) | ((rest == half) & (n % 2 == 1)), 1).otherwise(0)
        shown = _plain(n, digits - 1 - e)
        if e == digits - 1:
            shown = F.when(n == 10**digits, F.lit(f"1e+{digits:02d}")).otherwise(shown)
        out = F.when((x >= 10.0**e) & (x < 10.0 ** (e + 1)), shown).otherwise(out)
    text = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.substring_index(text, "e", -1).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(F.substring_index(text, "e", 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-exponent - 1, F.lit(0))), F.replace(mantissa, F.lit("."), F.lit("")))
    return (
        F.when(x == 0, "0")
        .when(x >= 10.0**digits, power)
        .when(x >= 1, out)
        .when(exponent == 0, mantissa)
        .when(exponent >= -4, small)
        .otherwise(power)
    )


def _scaled(x: Column, steps: list[tuple[float, str]], digits: int) -> Column:
    """``x`` over the largest of the rising ``steps`` that it reaches, and the unit of that step."""
    value, unit = x, F.lit(steps[0][1])
    for size, name in steps[1:]:
        value = F.when(x >= size, x / size).otherwise(value)
        unit = F.when(x >= size, name).otherwise(unit)
    return F.concat(significant(value, digits), unit)


def to_si(n: Column) -> Column:
    """Three significant digits with a blank and the unit of thousands."""
    return _scaled(n.cast("double"), [(1.0, " ")] + [(1000.0**i, f" {u}") for i, u in enumerate(UNITS, 1)], 3)


def bytes_to_si(n: Column) -> Column:
    """Three significant digits and the unit of powers of 1024; whole below 1024."""
    scaled = _scaled(n.cast("double"), [(1.0, "")] + [(1024.0**i, u) for i, u in enumerate(UNITS, 1)], 3)
    return F.when(n < 1024, n.cast("bigint").cast("string")).otherwise(scaled)


def to_engineering(n: Column) -> Column:
    """Four significant digits, from ten million with e6, e9 or e12; whole numbers below stay whole."""
    x = n.cast("double")
    value = F.when(x >= 1e12, x / 1e12).when(x >= 1e9, x / 1e9).when(x >= 1e7, x / 1e6).otherwise(x)
    unit = F.when(x >= 1e12, "e12").when(x >= 1e9, "e9").when(x >= 1e7, "e6").otherwise("")
    return F.when((x < 1e7) & (x == F.floor(x)), F.floor(x).cast("bigint").cast("string")).otherwise(F.concat(significant(value, 4), unit))


def _quantity(s: Column, base: int) -> Column:
    number = F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1)
    unit = F.lower(F.regexp_extract(s, r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)\s*(\S*)", 1))
    factor = F.when(unit == "", F.lit(1.0))
    for power, letter in enumerate(UNITS.lower(), 1):
        factor = factor.when(unit == letter, F.lit(float(base) ** power))
    return F.when(number == "", F.lit(0.0)).otherwise(F.coalesce(number.try_cast("double") * factor, F.lit(0.0)))


def from_si(s: Column) -> Column:
    """Number with an optional unit of thousands; 0 without a number or with another unit."""
    return _quantity(s, 1000)


def si_to_bytes(s: Column) -> Column:
    """Number with an optional unit of powers of 1024, rounded up; 0 without a number or with another unit."""
    return F.ceil(_quantity(s, 1024)).cast("bigint")


def transcript_of(exon_id: Column) -> Column:
    """An exon's name without its last two parts."""
    parts = F.split(exon_id, "_")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def exons_of(label: Column) -> Column:
    """The exons of a merged label."""
    return F.split(label, "_OR_")
