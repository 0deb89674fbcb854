"""Table operators for keeping a warehouse in step with its sources, on Spark."""
