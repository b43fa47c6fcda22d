"""Compaction planning, quorum analytics, and the catalogue of registered queries."""
