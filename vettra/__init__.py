"""vettra: watchlist screening as Spark DataFrame and Structured Streaming jobs."""
