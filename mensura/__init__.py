"""mensura: quantity-takeoff analytics as Spark DataFrame transformations."""
