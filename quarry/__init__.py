"""quarry: relational, byte-level and codec analytics written for Spark."""
