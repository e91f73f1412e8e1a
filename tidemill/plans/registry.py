"""Where queries over the synthetic tables register, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from tidemill.sources.tables import SQL

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Register a function of (spark, sf_dir). sql may start with further CTEs
    and ", ", or with SELECT; the views of sources.tables are put before it."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            if views:
                body = f"WITH {SQL}" + (",\n" if not body.upper().startswith("SELECT") else "\n") + body
            elif not body.upper().startswith("SELECT"):
                body = f"WITH {body}"
            ORACLE_SQL[f.__name__] = body
        return f

    return register
