"""quire: document analytics on Spark."""
