"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from salespanel.functions.scalar import (  # noqa: F401
    any_not_null,
    coerce_bool,
    exact_mean,
    exact_sum,
    nan_to_null,
    null_tokens_to_null,
    parse_date,
    pct_change,
    pearson,
    typed,
)
