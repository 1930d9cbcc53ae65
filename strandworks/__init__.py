"""Analytics on sensor traces, their headers and classification records, as Spark jobs."""
