"""Named queries (spark, folder) -> DataFrame and the equivalent SQL."""
