"""Versioned-table analytics on PySpark: snapshots, scans, merges, transactions and compaction as DataFrame operators."""
