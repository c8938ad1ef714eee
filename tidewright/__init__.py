"""tidewright: document-knowledge analytics as Spark DataFrame operators."""
