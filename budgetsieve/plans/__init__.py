"""Method registry, driver loops and the catalogue of queries."""
