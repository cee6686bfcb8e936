"""operators of the document-consistency engine."""
