"""From queries to Spark plans."""
