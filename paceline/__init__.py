"""Race-timing analytics on Spark: detections in, ranked leaderboards out."""
