"""Name -> query and DuckDB SQL, over all operator groups."""

from __future__ import annotations

from quern.plans import answers, base, checks, dispatch, evaluation, news, policy, retrieval, series, stores, text, vendors  # noqa: F401  (they register their queries)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
