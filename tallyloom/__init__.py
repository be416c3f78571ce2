"""tallyloom: text-and-label analytics as composable Spark DataFrame transformations."""
