"""pathloom: pathway models, weighted networks and enrichment statistics on Spark."""
