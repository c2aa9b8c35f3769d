"""Small shared helpers for column expressions."""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def built_once(fn):
    """A column function whose expression is built once for the same column names.

    Large expressions take hundreds of calls to the JVM to build; an expression
    over names is the same one wherever it is used.  Arguments that are Columns
    are built anew.
    """
    known: dict = {}

    @wraps(fn)
    def call(*args):
        if not all(isinstance(a, str) for a in args):
            return fn(*args)
        key = (id(SparkContext._gateway), args)
        if key not in known:
            known[key] = fn(*args)
        return known[key]

    return call


def str_array(values) -> Column:
    """A literal ARRAY<STRING> (empty list gives a typed empty array)."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def empty_str_array() -> Column:
    return F.array().cast("array<string>")


def rlike(text, pat) -> Column:
    """Regex search where the pattern may be a column."""
    if isinstance(pat, str):
        pat = F.lit(pat)
    return F.regexp_like(col_of(text), pat)


def rx_extract(text, pat, idx: int = 1) -> Column:
    """regexp_extract where the pattern may be a column."""
    if isinstance(pat, str):
        pat = F.lit(pat)
    return F.call_function("regexp_extract", col_of(text), pat, F.lit(idx))


def first_match(pats, text, flags: str = "") -> Column:
    """First pattern of an ARRAY<STRING> (in list order) that matches text."""
    text = col_of(text)
    return F.try_element_at(
        F.filter(F.coalesce(col_of(pats), empty_str_array()),
                 lambda p: rlike(text, F.concat(F.lit(flags), p) if flags else p)),
        F.lit(1))


def any_match(pats, text, flags: str = "") -> Column:
    """True when any pattern of the array is found in text (search, not full match)."""
    text = col_of(text)
    return F.coalesce(F.exists(
        F.coalesce(col_of(pats), empty_str_array()),
        lambda p: rlike(text, F.concat(F.lit(flags), p) if flags else p)),
        F.lit(False))


def steps(df, col: str, *fns):
    """Apply column steps one projection at a time.

    Each step reads the previous result by name, so an expensive expression
    that a step uses several times is computed once (the optimizer does not
    inline a non-trivial expression into a consumer that references it
    more than once) instead of the expression tree growing with every step.
    """
    for fn in fns[:-1]:
        df = df.withColumn(col, fn(F.col(col)))
    return materialize(df, **{col: fns[-1](F.col(col))}) if fns else df


def materialize(df, **exprs):
    """Add columns behind an optimizer barrier.

    The columns are produced by a one-row ``inline`` generator, so later
    filters and projections refer to the computed values instead of having
    the expressions substituted into them (predicate pushdown otherwise
    copies an expensive expression into every condition that uses it, and
    nested helpers grow exponentially).  No data moves: one output row per
    input row.
    """
    if not exprs:
        return df
    keep = [c for c in df.columns if c not in exprs]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def let(value, body) -> Column:
    """Bind ``value`` once and evaluate ``body(v)`` (a one-element ``transform``).

    Inside higher-order functions there is no common-subexpression
    elimination, so a value used several times is bound instead of copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
