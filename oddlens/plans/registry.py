"""Names of the queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under name."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


from oddlens.plans import evaluation_queries, stream_queries, table_queries, vector_queries  # noqa: E402, F401
