"""Panel feature and evaluation engine on Spark."""
