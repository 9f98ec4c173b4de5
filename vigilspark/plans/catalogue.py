"""Names of all domain queries, with their SQL."""

from __future__ import annotations

from vigilspark.plans import behaviour_plans, case_plans, decision_plans, intel_plans, link_plans, more_plans, report_plans, stream_plans, text_plans, view_plans

FLAGSHIP = "case_status_counts"
_PARTS = (case_plans, text_plans, behaviour_plans, link_plans, intel_plans, decision_plans, more_plans, report_plans, stream_plans, view_plans)
QUERIES: dict = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: s for part in _PARTS for name, s in part.ORACLE.items()}
