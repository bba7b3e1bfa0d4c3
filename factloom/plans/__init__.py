"""The query catalogue: Spark plans and the equivalent SQL."""
