"""Job-posting analytics as composable Spark DataFrame operators."""
