"""Schedule gate (T5): did a weekday or a day of the month fall between two times?

Pure column logic.  ``when`` is the site's rule text: '' or null means
always; an integer is a day of the month; otherwise the first two letters
name a weekday.  Spans over 31 (day of month) or 7 (weekday) days always
pass.  A bad rule or a negative span yields null from ``falls_between`` and a
reason from ``schedule_error``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.common import col_of

# Weekday prefixes, Monday first.
WEEKDAYS = ["mo", "tu", "we", "th", "fr", "sa", "su"]

INT_RE = r"^\s*[+-]?[0-9]+\s*$"


def days_between(t1, t2) -> Column:
    """Fractional days from t1 to t2."""
    return F.timestamp_diff("MICROSECOND", col_of(t1), col_of(t2)) / F.lit(86400000000.0)


def _parts(when):
    w = col_of(when)
    is_dom = w.rlike(INT_RE)
    dom = F.when(is_dom, F.trim(w).cast("int"))
    dow = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]),
                           F.lower(F.substring(w, 1, 2))) - 1
    return w, is_dom, dom, dow


def schedule_error(when, t1, t2) -> Column:
    """Why the rule cannot be evaluated, or null."""
    w, is_dom, _, dow = _parts(when)
    dd = days_between(t1, t2)
    empty = w.isNull() | (w == "")
    return (F.when(empty, F.lit(None).cast("string"))
            .when(dd < 0, F.lit("negative span"))
            .when(is_dom, F.lit(None).cast("string"))
            .when(F.length(w) < 2, F.lit("rule too short"))
            .when(dow < 0, F.lit("not a day"))
            .otherwise(F.lit(None).cast("string")))


def falls_between(when, t1, t2) -> Column:
    """True when the scheduled day lies in (t1, t2]; see module doc."""
    w, is_dom, dom, dow = _parts(when)
    t1, t2 = col_of(t1), col_of(t2)
    dd = days_between(t1, t2)
    empty = w.isNull() | (w == "")
    dom_rule = (F.when(dd > 31, F.lit(True))
                .when(F.month(t1) == F.month(t2),
                      (F.dayofmonth(t1) <= dom) & (F.dayofmonth(t2) >= dom))
                .otherwise((F.dayofmonth(t1) < dom) | (dom <= F.dayofmonth(t2))))
    dow_rule = (F.when(dd > 7, F.lit(True))
                .otherwise(F.pmod(F.weekday(t2) - dow, F.lit(7)) < dd))
    return (F.when(empty, F.lit(True))
            .when(schedule_error(when, t1, t2).isNotNull(), F.lit(None).cast("boolean"))
            .when(is_dom, dom_rule)
            .otherwise(dow_rule))


def gate(when, t1, t2) -> Column:
    """'yes' or 'no' by ``falls_between``, 'error: ' and the reason, or 'first' where there is no earlier run."""
    err = schedule_error(when, t1, t2)
    return (F.when(col_of(t1).isNull(), F.lit("first"))
            .when(err.isNotNull(), F.concat(F.lit("error: "), err))
            .when(falls_between(when, t1, t2), F.lit("yes")).otherwise(F.lit("no")))
