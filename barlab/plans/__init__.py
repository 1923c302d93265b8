"""Registered queries of the bar library and their oracle SQL."""

from __future__ import annotations

from . import analysis, decisions, features, models

QUERIES: dict = features.Q | analysis.Q | decisions.Q | models.Q
ORACLES: dict = features.O | analysis.O | decisions.O | models.O
FLAGSHIP = "break_signal_summary"
