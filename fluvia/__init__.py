"""Log and event pipelines as Spark DataFrame and Structured Streaming operators."""
