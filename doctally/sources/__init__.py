"""sources of the document-consistency engine."""
