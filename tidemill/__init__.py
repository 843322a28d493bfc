"""tidemill: corpus analytics and authorship attribution on Spark."""
