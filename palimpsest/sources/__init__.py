"""Tables on Parquet with a JSON manifest, and run statistics for pruning."""
