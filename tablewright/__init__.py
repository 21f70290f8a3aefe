"""Tablewright: judge, clean, unify and reconcile business tables on Spark."""

from tablewright.session import build_session

__all__ = ["build_session"]
