"""Every registered query."""

from __future__ import annotations

from suite.causal import causal_queries
from suite.decisions import decision_queries
from suite.metrics import metric_queries
from suite.models import model_queries
from suite.quality import quality_queries
from suite.showcase import showcase_queries
from suite.sources import source_queries
from suite.spec import Query


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for part in (model_queries, showcase_queries, decision_queries, causal_queries, metric_queries, quality_queries, source_queries):
        out.update(part())
    return out
