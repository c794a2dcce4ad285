"""All queries of the library, with their SQL."""

from . import q_depth, q_more, q_space, q_stats  # noqa: F401  they register themselves
from .registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
