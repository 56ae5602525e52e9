"""Column expressions shared by the operators (all JVM-side built-ins)."""

from churnlab.functions.dates import cohort, day_diff, in_window, to_day, utc_day
from churnlab.functions.predicates import any_of, none_of
from churnlab.functions.rounding import half_up_mean_2dp

__all__ = [
    "any_of",
    "cohort",
    "day_diff",
    "half_up_mean_2dp",
    "in_window",
    "none_of",
    "to_day",
    "utc_day",
]
