"""Financial-disclosure analytics on Spark: facts, lookups, ratios, retrieval and sessions as DataFrame jobs."""
