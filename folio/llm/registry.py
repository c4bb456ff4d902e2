"""The queries of this subpackage, by name, with their SQL."""

from __future__ import annotations

from folio.llm import queries as q


def queries() -> dict:
    return {name: f for name, f in vars(q).items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from folio.llm import sql

    return dict(sql.ORACLE)
