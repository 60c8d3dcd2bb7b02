"""Name -> query and name -> SQL, gathered from the plan modules."""

from heronlake.plans import catalog_plans, chunk_plans, event_plans, gate_plans, graph_plans, item_plans, novelty_plans, retrieval_plans, spec_plans, store_plans, text_plans  # noqa: F401
from heronlake.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
