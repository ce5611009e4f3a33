"""Input views, whole-job compositions and the query catalogue."""
