"""windlass: race rating analytics written as Spark DataFrame programs."""
