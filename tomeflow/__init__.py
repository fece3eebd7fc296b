"""Document-to-speech analytics as Spark DataFrame programs."""
