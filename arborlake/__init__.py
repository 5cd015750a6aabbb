"""Structure-aware document analytics on Spark."""
