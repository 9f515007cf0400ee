"""tenderloom: supplier-discovery analytics expressed as Spark DataFrame jobs."""
