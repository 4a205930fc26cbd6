"""The reference-operator queries, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from lexforge.plans import archived, curation, events, monitoring, more, notes, relational, reviewing, searching, spelling, texts, vectors
from lexforge.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "archived", "curation", "events", "monitoring", "more", "notes", "relational", "reviewing", "searching", "spelling", "texts", "vectors"]
