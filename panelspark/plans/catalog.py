"""All registered queries."""

from panelspark.plans import effect_queries, model_queries, panels, relational, report_queries, rolls  # noqa: F401
from panelspark.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "q29_scenario_averted"
