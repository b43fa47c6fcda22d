"""DataFrame operators over a changelog: reads, merges, writes, transactions, compaction."""
