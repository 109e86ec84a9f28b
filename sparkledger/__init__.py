"""Evidence-backed analytics and data processing on PySpark."""
