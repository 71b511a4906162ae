"""docsieve: document-extraction analytics as Spark DataFrame jobs."""
