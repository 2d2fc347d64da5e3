"""Analytics over curated feeds, as Spark jobs."""
