"""Named queries bound to the test tables and their oracle SQL."""

from contingo.plans.common import REGISTRY  # noqa: F401
from contingo.plans import enrichment, features, io_q, reports, textq  # noqa: F401  (registers queries)


def all_queries():
    return {k: v[0] for k, v in REGISTRY.items()}


def all_oracles():
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
