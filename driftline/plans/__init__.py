from driftline.plans.flows import Source, run
from driftline.plans.routing import gap_detect, no_change_skip, plan_tables, state_transition

__all__ = [
    "Source",
    "gap_detect",
    "no_change_skip",
    "plan_tables",
    "run",
    "state_transition",
]
