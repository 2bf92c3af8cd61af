"""recollect: memory and code-context analytics as lazy Spark DataFrame operators."""
