"""All queries of the library and their SQL."""

from __future__ import annotations

from . import captioning, editorial, panel, publishing, segments, stored, timeline

QUERIES = {**segments.QUERIES, **captioning.QUERIES, **publishing.QUERIES, **editorial.QUERIES, **panel.QUERIES, **timeline.QUERIES, **stored.QUERIES}
ORACLE = {**segments.ORACLE, **captioning.ORACLE, **publishing.ORACLE, **editorial.ORACLE, **panel.ORACLE, **timeline.ORACLE, **stored.ORACLE}
