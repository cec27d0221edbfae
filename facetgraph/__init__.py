"""People-graph search and corpus operators on Spark."""
