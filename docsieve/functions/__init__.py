"""Part of docsieve."""
