"""Registered queries: one per operator of the inventory, each with its oracle SQL where one exists."""

from __future__ import annotations

from .registry import ORACLES, QUERIES, query
from .flagship import feature_ranking, feature_ranking_sql

query("flagship_feature_ranking", feature_ranking_sql())(feature_ranking)


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from . import q_clean, q_explore, q_split_impute, q_scale, q_select, q_evaluate, q_summarise  # noqa: F401
    from . import q_io, q_models, q_explain, q_neighbours  # noqa: F401


__all__ = ["ORACLES", "QUERIES", "load_all"]
