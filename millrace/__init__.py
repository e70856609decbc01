"""millrace: web pages to a clean, deduplicated catalogue, as Spark jobs."""
