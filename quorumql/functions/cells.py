"""One text form per cell value, so that rows of any query can be compared and grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_EXACT_LONG = 9.0e18  # whole doubles below this in size convert to BIGINT without loss
_EXACT_DECIMAL = 1.0e38  # whole doubles below this in size fit DECIMAL(38)


def _plain_decimal(value: Column, precision: int) -> Column:
    text = value.cast(T.DecimalType(38, precision)).cast("string")
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")) if precision else text


def cell(value: Column, dtype: T.DataType, precision: int = 6) -> Column:
    """Canonical text of one value; equal values give equal text, whatever numeric type carries them.

    Numbers are ``d:`` plus their plain decimal form at ``precision`` places (half up), so 1, 1.0 and true agree;
    everything else is ``s:`` plus its text, so 1 and '1' differ while a blob equals its hex text. Null stays null.
    """
    if isinstance(dtype, T.BooleanType):
        return F.concat(F.lit("d:"), value.cast("int").cast("string"))
    if isinstance(dtype, T.IntegralType):
        return F.concat(F.lit("d:"), value.cast("string"))
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        number = value.cast("double")
        size = F.abs(number)
        # Most numbers take one of the first two ways; a double with a fraction is far below the decimal's bound.
        whole = number == F.rint(number)
        text = (
            F.when(whole & (size < _EXACT_LONG), number.cast("bigint").cast("string"))
            .when(~whole & (size < _EXACT_LONG), _plain_decimal(number, precision))
            .when(size < _EXACT_DECIMAL, number.cast("decimal(38,0)").cast("string"))
            .otherwise(number.cast("string"))
        )
        return F.concat(F.lit("d:"), text)
    if isinstance(dtype, T.DecimalType):
        places = min(precision, dtype.scale)
        rounded = F.round(value, places).cast("string")
        text = F.rtrim(F.rtrim(rounded, F.lit("0")), F.lit(".")) if places else rounded
        return F.concat(F.lit("d:"), text)
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit("s:"), F.lower(F.hex(value)))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.concat(F.lit("s:"), F.to_json(value, {"ignoreNullFields": "false"}))
    return F.concat(F.lit("s:"), value.cast("string"))


def canonical_cells(df: DataFrame, columns: list[str] | None = None, precision: int = 6) -> Column:
    """Array of canonical cells of the given columns of ``df``, in order; column names play no part."""
    names = df.columns if columns is None else columns
    if not names:
        return F.array().cast("array<string>")
    return F.array(*[cell(F.col(f"`{n.replace('`', '``')}`"), df.schema[n].dataType, precision) for n in names])


def shown_cells(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Array of tagged cells with values as they are, for display: ``j:`` and JSON text of a number or boolean, else
    ``s:`` and text. Numbers that JSON lacks (NaN, infinities) are text."""
    names = df.columns if columns is None else columns
    if not names:
        return F.array().cast("array<string>")
    return F.array(*[_shown(F.col(f"`{n.replace('`', '``')}`"), df.schema[n].dataType) for n in names])


def _shown(value: Column, dtype: T.DataType) -> Column:
    text = value.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.concat(F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit("s:")).otherwise(F.lit("j:")), text)
    if isinstance(dtype, (T.BooleanType, T.NumericType)):
        return F.concat(F.lit("j:"), text)
    return cell(value, dtype)


def row_hashes(cells: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of one row; JSON keeps null cells in place, which hashing the array would not."""
    text = F.to_json(cells)
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)
