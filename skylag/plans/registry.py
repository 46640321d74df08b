"""All registered queries (SQL-checked catalog + model and streaming jobs)."""

from __future__ import annotations


def all_queries():
    from . import catalog, logs, modeling
    from ..streaming import jobs
    out = dict(catalog.Q)
    out.update(logs.Q)
    out.update(modeling.Q)
    out.update(jobs.Q)
    return out
