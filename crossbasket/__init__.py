"""Customer-overlap analytics for retail chains, expressed as Spark DataFrame plans."""
