"""All registered queries over the given tables."""

from reviewlake.plans import corpora, merges, models, rankings, statistics, texts  # noqa: F401
from reviewlake.plans.registry import ORACLE, QUERIES  # noqa: F401
