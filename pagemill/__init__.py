"""Document-text analytics as Spark DataFrame transformations."""
