"""Registry of queries (one per inventory row) and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn

    return deco


def load_all() -> None:
    # importing the modules fills the registry
    import importlib

    for name in MODULES:
        importlib.import_module(f"mixtext.plans.{name}")


MODULES = ["q_prep", "q_scoring", "q_errors", "q_features", "q_models", "q_reconcile", "q_io"]
