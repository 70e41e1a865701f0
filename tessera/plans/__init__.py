"""Query bindings: each registered query is a Spark plan over the given tables
plus an independent DuckDB SQL oracle for the same result."""

from .registry import QUERIES, ORACLES, query  # noqa: F401


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from . import commands, documents, edits, gochains, gosource, pages, session, types  # noqa: F401
