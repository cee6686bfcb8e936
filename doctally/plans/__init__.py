"""plans of the document-consistency engine."""
