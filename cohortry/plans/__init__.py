"""From text to typed Spark plans."""
