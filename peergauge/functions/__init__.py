"""Column expressions; all run inside the JVM."""

from peergauge.functions.dates import day_gap, period_start, slice_start
from peergauge.functions.labels import normalise_label, normalise_yes_no, usable
from peergauge.functions.rates import (
    count_where,
    is_favourable,
    is_timely,
    pct,
    rounded,
    subject_or_rest,
)
from peergauge.functions.text import clip, non_empty, strip

__all__ = [
    "clip",
    "count_where",
    "day_gap",
    "is_favourable",
    "is_timely",
    "non_empty",
    "normalise_label",
    "normalise_yes_no",
    "pct",
    "period_start",
    "rounded",
    "slice_start",
    "strip",
    "subject_or_rest",
    "usable",
]
