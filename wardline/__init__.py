"""Clinical-style event timelines, features and model-output summaries on Spark."""
