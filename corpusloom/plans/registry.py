"""The library's registered queries and their SQL."""

from __future__ import annotations

from . import analysis, ranking, relational, texts
from ._base import Query

FLAGSHIP = "w1_keep_latest"
BOOKS = [relational.BOOK, texts.BOOK, analysis.BOOK, ranking.BOOK]


def queries() -> dict[str, Query]:
    return {k: v for book in BOOKS for k, v in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for book in BOOKS for k, v in book.sql.items()}
