"""Registered queries over the given tables, each with its SQL equivalent where one exists."""

from . import aggregates, algebra, corpus, derived, plan_corpus, record_batch, scores, tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
