"""Scalar and aggregate column expressions shared by the operators.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen. Spark 4 runs in ANSI mode: nothing here may
raise on bad input, so parsing uses ``try_*`` forms and division is guarded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from salespanel.schemas import NULL_TOKENS

# Sums of the sales measures run in DECIMAL where every value fits it, so that
# the result does not depend on the order rows arrive in (double addition is not
# associative). Four places covers every measure of the panel (prices x discounts).
SUM_DECIMAL = "DECIMAL(18,4)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_tokens_to_null(c: str | Column) -> Column:
    """Text cell -> null when it is one of the CSV null tokens."""
    c = _col(c)
    return F.when(c.isin(*NULL_TOKENS), F.lit(None)).otherwise(c)


def nan_to_null(c: str | Column) -> Column:
    """NaN -> null, so that NaN and null are one thing (as in pandas)."""
    c = _col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# Decimal number text; Spark's own cast would also read 1d, 1f or 0x1p3.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def number_text(c: str | Column) -> Column:
    """The text where it spells a decimal number, else null."""
    c = _col(c).cast("string")
    return F.when(c.rlike(NUMBER), c)


def parse_date(c: str | Column, fmt: str = "d/M/yyyy") -> Column:
    """Day/month/year text -> DATE; anything unparseable (31/02, ISO text) -> null.

    ``d/M`` accepts both padded (05/02/2010) and unpadded (5/2/2010) forms.
    """
    return F.try_to_date(_col(c), fmt)


def coerce_bool(c: str | Column, unknown: str = "null") -> Column:
    """TRUE/FALSE text (any case, padded) -> boolean.

    ``unknown`` decides what other text and nulls become: ``"null"`` (the
    default, so a non-null contract catches them) or ``"true"`` (reproduces the
    reference, where any unrecognised value turns into True).
    """
    u = F.upper(F.trim(_col(c).cast("string")))
    out = F.when(u == "TRUE", F.lit(True)).when(u == "FALSE", F.lit(False))
    if unknown == "true":
        return out.otherwise(F.lit(True))
    if unknown != "null":
        raise ValueError("unknown must be 'null' or 'true'")
    return out.otherwise(F.lit(None).cast("boolean"))


def typed(c: str | Column, spark_type: str) -> Column:
    """Typed value of a text column: null tokens -> null, NaN -> null,
    unparseable -> null (never an error)."""
    v = null_tokens_to_null(c)
    if spark_type == "date":
        return parse_date(v)
    if spark_type == "boolean":
        return coerce_bool(v)
    if spark_type == "string":
        return v
    if spark_type in ("int", "bigint", "long"):
        # integral text in any numeric form ("12", "12.0", "1.2e1"); a
        # fraction or an out-of-range value is not an integer -> null; the
        # value itself goes by DECIMAL, as a double holds 53 bits only
        v = number_text(v)
        d = v.try_cast("double")
        return F.when(d == F.rint(d), v.try_cast("DECIMAL(38,0)").try_cast(spark_type))
    if spark_type in ("double", "float"):
        v = number_text(v)
    out = v.try_cast(spark_type)
    if spark_type == "double":
        out = nan_to_null(out)
    return out


def exact_sum(c: str | Column) -> Column:
    """Sum of a sales measure as DOUBLE: order-independent if each value of
    the group has at most four places, a floating sum (with infinities and
    values of any size) otherwise, or where the exact sum leaves DECIMAL."""
    c = _col(c).cast("double")
    d = c.try_cast(SUM_DECIMAL)
    fits = F.bool_and(F.when(c.isNotNull(), F.coalesce(d.cast("double") == c, F.lit(False))))
    return F.coalesce(F.when(fits, F.try_sum(d).cast("double")), F.sum(c))


def exact_mean(c: str | Column) -> Column:
    """Mean of a sales measure, summed by ``exact_sum`` (null for an empty group)."""
    c = _col(c)
    return exact_sum(c) / F.nullif(F.count(c), F.lit(0))


def pct_change(y: str | Column, prev: str | Column) -> Column:
    """(y - prev) / |prev| with pandas' float rules instead of ANSI errors:
    prev = 0 and y != 0 -> +/-inf; 0/0 -> null (pandas NaN, dropped later)."""
    y, prev = _col(y), _col(prev)
    inf = F.lit(float("inf"))
    return (F.when(prev.isNull() | y.isNull(), F.lit(None).cast("double"))
            .when((prev == 0) & (y > 0), inf)
            .when((prev == 0) & (y < 0), -inf)
            .when(prev == 0, F.lit(None).cast("double"))
            .otherwise((y - prev) / F.abs(prev)))


def pearson(a: str | Column, b: str | Column) -> Column:
    """Pairwise-complete Pearson correlation that is null (not an ANSI error)
    for a constant column. Rows where either side is null are skipped."""
    a, b = _col(a), _col(b)
    both = a.isNotNull() & b.isNotNull()
    a2, b2 = F.when(both, a), F.when(both, b)
    denom = F.sqrt(F.var_pop(a2) * F.var_pop(b2))
    return F.covar_pop(a2, b2) / F.nullif(denom, F.lit(0.0))


def any_not_null(cols) -> Column:
    """True when at least one of ``cols`` holds a value."""
    return reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in cols])
