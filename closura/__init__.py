"""A rule materialisation engine for graph data on Spark."""
