"""Event-cohort operators: qualify, interval join, follow-on, flags, metrics."""

from churnlab.operators import cohorts
from churnlab.operators.flags import (
    attach_earlier,
    attach_outcomes,
    flag_by_key,
    flag_contract,
    flag_rows,
    flag_via_anchors,
    lift_flag,
    mark_contact,
    outcome_counts,
    segment_recurrence,
    split_contacted,
)
from churnlab.operators.metrics import detail, monthly_counts, monthly_distinct, monthly_mean_days, ordered
from churnlab.operators.skew import heavy_keys, shared_distinct, spread_left_join
from churnlab.operators.windows import events_within, follow_on, key_bins, reachable

__all__ = [
    "attach_earlier",
    "attach_outcomes",
    "cohorts",
    "detail",
    "events_within",
    "flag_by_key",
    "flag_contract",
    "flag_rows",
    "flag_via_anchors",
    "follow_on",
    "heavy_keys",
    "key_bins",
    "lift_flag",
    "mark_contact",
    "outcome_counts",
    "monthly_counts",
    "monthly_distinct",
    "monthly_mean_days",
    "ordered",
    "reachable",
    "segment_recurrence",
    "shared_distinct",
    "split_contacted",
    "spread_left_join",
]
