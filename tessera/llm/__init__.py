"""Operators of a training-data pipeline, each over whole tables.

``load_queries()`` imports the query modules and returns their queries and
oracle SQL; nothing outside this subpackage imports it except the entry file.
"""

from __future__ import annotations


def load_queries() -> tuple[dict, dict]:
    """(name -> query function, name -> oracle SQL) of this subpackage."""
    from .queries import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
