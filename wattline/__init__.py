"""Back-tested electricity forecasts and energy analytics as Spark jobs."""
