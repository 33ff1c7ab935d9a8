"""landrank: site ranking, detection and corpus preparation as Spark DataFrame plans."""
