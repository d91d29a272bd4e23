"""Query catalogue: Spark plans and their SQL oracles, keyed by query name."""
