"""Marketing analytics on Spark: bronze, silver and gold tables as DataFrame operators."""
