"""Short printable forms of values for dictionaries, previews and reports."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

from quorumql.functions.text import clip, strip

_EXACT_WHOLE = 1e15  # whole numbers below this convert to BIGINT digit by digit


def pattern_format(value: Column, pattern: str) -> Column:
    """Number text by a decimal pattern. Rounds the exact binary value, ties to even, as C and Python do;
    ``format_string`` would round the shortest decimal text instead and differ on values such as 80493.65.
    """
    return F.call_function("format_number", value, F.lit(pattern))


def _halved_to_even(value: Column, digits: int) -> Column:
    """The pattern rounds whole numbers lying exactly halfway away from zero; the ones that should go towards
    zero to reach an even digit are moved by one, which takes them off the tie."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - (digits - 1))
    falls = (F.abs(value) >= 10.0**digits) & (F.abs(value) < _EXACT_WHOLE) & (F.abs(value) % (unit * 2) == unit / 2)
    return F.when(falls, value - F.signum(value)).otherwise(value)


def general_format(value: Column, digits: int = 6) -> Column:
    """``%g`` text: ``digits`` significant digits, no trailing zeros, exponents of at least two digits."""
    scientific = pattern_format(_halved_to_even(value, digits), "0." + "#" * (digits - 1) + "E0")

    def layout(parts: Column) -> Column:
        power = parts[1].try_cast("int")
        plain = F.concat_ws("E", parts).try_cast(T.DecimalType(38, digits + 4)).cast("string")
        size = F.abs(power).cast("string")
        return F.when((power >= -4) & (power < digits), F.rtrim(F.rtrim(plain, F.lit("0")), F.lit("."))).otherwise(
            F.concat(
                parts[0], F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
                F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")),
            )
        )

    # The array of one binds mantissa and exponent to a name, so the formatted text is computed once.
    text = F.transform(F.array(F.split(scientific, "E")), layout)[0]
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .otherwise(text)
    )


def quoted_text(text: Column, max_len: int = 40) -> Column:
    flat = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    short = clip(flat, max_len, max_len - 3)
    return F.concat(F.lit("'"), F.replace(short, F.lit("'"), F.lit("''")), F.lit("'"))


def render_value(value: Column, dtype: T.DataType, max_len: int = 40) -> Column:
    """Printable form: text flattened, clipped and quoted; floats with six digits; the rest as it prints."""
    if isinstance(dtype, T.StringType):
        return quoted_text(value, max_len)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return general_format(value.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return value.cast("int").cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return value.cast("string")


def fixed_format(value: Column, places: int) -> Column:
    """Fixed-point text. The pattern rounds everything below one unit in the last place down; values from half a
    unit up are set to one unit first."""
    half, unit = float(f"5e-{places + 1}"), float(f"1e-{places}")
    size = F.abs(value)
    # The double next to half a unit may lie just below it; then only larger values round up.
    from_half = size >= half if Decimal(half) >= Decimal(f"5e-{places + 1}") else size > half
    shown = F.when(from_half & (size < unit), F.signum(value) * unit).otherwise(value)
    return pattern_format(shown, "0." + "0" * places)


def fixed_or_na(value: Column, places: int = 4) -> Column:
    """Fixed-point text, or ``n/a`` for a missing number."""
    return F.coalesce(fixed_format(value.cast("double"), places), F.lit("n/a"))


def json_text(text: Column) -> Column:
    """A JSON string literal with non-ASCII characters kept."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
