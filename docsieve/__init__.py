"""docsieve: document-evidence analytics and corpus preparation on PySpark."""
