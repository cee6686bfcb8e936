"""functions of the document-consistency engine."""
