"""Document retrieval and question analytics as Spark DataFrame operators."""
