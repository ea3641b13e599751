"""convan: conversation analytics as Spark DataFrame operators."""
