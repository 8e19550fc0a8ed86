"""Column building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bunkerline import reference as ref


def inline_table(spark: SparkSession, columns: str, rows: Sequence[tuple]) -> DataFrame:
    """A constant table as a local relation, so Catalyst knows how small it is."""
    names = [part.strip().split(" ") for part in columns.split(",")]

    def cell(value, kind):
        if value is None:
            return f"CAST(NULL AS {kind})"
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, str):
            return "'" + value.replace("'", "\\'") + "'"
        return f"CAST({value!r} AS {kind})"

    body = ", ".join(
        "(" + ", ".join(cell(v, kind) for v, (_, kind) in zip(row, names, strict=True)) + ")"
        for row in rows
    )
    aliases = ", ".join(name for name, _ in names)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({aliases})")


def rnd(column: Column | str, digits: int) -> Column:
    """Round half away from zero in binary arithmetic; adding zero turns -0.0 into 0.0.

    ``round(x, n)`` on a double goes through its decimal text, which other engines do not do,
    so ties such as 1.005 would differ between them.
    """
    column = F.col(column) if isinstance(column, str) else column
    scale = F.lit(10.0**digits)
    return F.round(column * scale, 0) / scale + F.lit(0.0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null unless the denominator is strictly positive."""
    return F.when(denominator > 0, numerator / denominator)


def clip(column: Column, low, high) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def trimmed(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


# a whole-cell number, with thousands separators allowed
NUMBER_CELL = r"(?i)^\\s*[+-]?(?:[0-9,]+\\.?[0-9,]*|\\.[0-9]+)(?:e[+-]?[0-9]+)?\\s*$|^\\s*[+-]?inf(?:inity)?\\s*$"


def as_number(name: str) -> Column:
    """Text column to double; null tokens, error tokens and junk all become null.

    One anchored pattern admits numbers, so no token list has to be tested per cell and a
    failing cast never raises and catches inside the scan.
    """
    return F.expr(
        f"CASE WHEN `{name}` RLIKE '{NUMBER_CELL}' THEN try_cast(replace(`{name}`, ',', '') AS double) END"
    )


def quoted_list(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def cell_kind(name: str) -> Column:
    """number, null, error or unparseable."""
    return F.expr(
        f"CASE WHEN `{name}` IS NULL THEN 'null' WHEN `{name}` RLIKE '{NUMBER_CELL}' THEN 'number' "
        f"WHEN lower(trim(`{name}`)) IN ({quoted_list(ref.NULL_TOKENS)}) THEN 'null' "
        f"WHEN lower(trim(`{name}`)) IN ({quoted_list(ref.ERROR_TOKENS)}) THEN 'error' ELSE 'unparseable' END"
    )


def as_category(name: str) -> Column:
    """Trimmed text; cells a workbook reader treats as missing become null."""
    return F.expr(f"CASE WHEN `{name}` NOT IN ({quoted_list(ref.READER_NA_TOKENS)}) THEN trim(`{name}`) END")


def literal_map(values: Mapping[str, float | int | str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def case_map(column: Column, values: Mapping, default=None) -> Column:
    """Small constant lookup as one CASE expression."""
    chain = None
    for key, value in values.items():
        chain = F.when(column == key, F.lit(value)) if chain is None else chain.when(
            column == key, F.lit(value)
        )
    return chain.otherwise(F.lit(default))


def piecewise_linear(column: Column, points: Mapping[int, float]) -> Column:
    """Linear between the given points, flat outside them."""
    knots = sorted(points.items())
    chain = F.when(column <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        value = F.lit(float(y0)) + (column - x0) / F.lit(float(x1 - x0)) * F.lit(float(y1 - y0))
        chain = chain.when(column < x1, value)
    return F.when(column.isNotNull(), chain.otherwise(F.lit(float(knots[-1][1]))))


def md5_uniform(*parts: Column) -> Column:
    """A uniform in [0, 1) that depends only on the given key parts."""
    digest = F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def float_bin(column: Column, per_octave: int = 256) -> Column:
    """Order-preserving integer bin of a double: equal relative width, no data pass needed."""
    offset = 1100 * per_octave  # doubles reach down to 2**-1074

    def magnitude(value: Column) -> Column:
        return F.floor(F.log2(value) * per_octave).cast("bigint") + F.lit(offset)

    return (
        F.when(column > 0, magnitude(column))
        .when(column == 0, F.lit(0).cast("bigint"))
        .when(column < 0, -magnitude(-column))
    )


def weakest_confidence(*labels: Column) -> Column:
    """The least certain of the labels present; provisional when none is."""
    ranks = [case_map(c, ref.CONFIDENCE_RANK) for c in labels]
    worst = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return F.when(worst == 0, "high").when(worst == 1, "medium").otherwise("provisional")


def bool_int(column: Column) -> Column:
    return F.coalesce(column, F.lit(False)).cast("int")
