"""Document and conversation analytics as PySpark DataFrame operators."""
