"""streaming of the document-consistency engine."""
