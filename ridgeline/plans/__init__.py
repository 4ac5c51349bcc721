"""Query plans: fixture frames, the flagship and the registered query catalogue."""

from __future__ import annotations


def load_all():
    """Import every catalogue module so their queries register."""
    from . import q_wrangle, q_splits  # noqa: F401
    for mod in ("q_linear", "q_trees", "q_ensembles", "q_checks"):
        try:
            __import__(f"{__name__}.{mod}")
        except ModuleNotFoundError as e:
            if mod not in str(e):
                raise
    from .registry import ORACLE, QUERIES
    return QUERIES, ORACLE
