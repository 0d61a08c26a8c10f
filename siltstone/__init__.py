"""siltstone: log normalisation and corpus preparation expressed as Spark DataFrame jobs."""
