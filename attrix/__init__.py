"""Customer-attrition analytics on Spark."""
