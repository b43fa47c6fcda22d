"""Column functions: keys and bounds, Bloom filters, block layout."""
