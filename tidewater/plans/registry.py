"""Every query of the core, with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from tidewater.operators import intervals
from tidewater.plans import acquire, bundles, live, page, parsing, scalars, states, timeline, trust, words  # noqa: F401
from tidewater.plans.base import QUERIES as _PLANNED

FLAGSHIP = "live_summary"
QUERIES = {
    "p5_found": (intervals.p5_found, intervals.P5_SQL),
    "interval_periods": (intervals.interval_periods, intervals.PERIODS_SQL),
    **_PLANNED,
}
