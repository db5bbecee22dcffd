"""All registered queries."""

from attestry.plans import (  # noqa: F401
    answering, asking, clusters, evaluation, eventlog, evidence, graphs, joins, ranking, textjobs,
)
from attestry.plans.registry import ORACLES, QUERIES  # noqa: F401
