"""Document-consistency analytics on Spark."""
