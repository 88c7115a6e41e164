"""turnwise: dialogue-outcome analytics as PySpark DataFrame jobs."""
