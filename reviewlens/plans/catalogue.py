"""All named queries."""

from __future__ import annotations

from reviewlens.plans import q_io, q_label, q_learn, q_state, q_stream, q_table, q_text  # noqa: F401
from reviewlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
