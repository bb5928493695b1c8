"""Analytics jobs on Spark: leaderboards, summaries, panels and feed ingestion."""
