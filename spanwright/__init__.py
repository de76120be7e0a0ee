"""spanwright: timed-span and corpus analytics expressed as Spark DataFrame plans."""
