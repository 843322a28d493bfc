"""The registered queries of the core."""

from __future__ import annotations

from tidemill.plans import corpus, evaluation, features, flows, preparation, sampling, training, vocabulary  # noqa: F401
from tidemill.plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
