"""inkstone: document analytics expressed as composable Spark DataFrame operators."""
