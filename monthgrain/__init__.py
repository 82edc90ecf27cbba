"""Monthly multi-geography series analytics expressed as Spark DataFrame transformations."""
