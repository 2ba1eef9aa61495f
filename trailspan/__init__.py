"""Points of interest along GPS tracks, as Spark jobs."""
