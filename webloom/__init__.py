"""Analytics on collections of web-page snapshots and texts, on Spark."""
