"""Spark-first posting analytics: declarative DataFrame operators, sources and plans."""

from postmill.session import get_session

__all__ = ["get_session"]
