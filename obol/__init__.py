"""obol: credit default-risk analytics as Spark DataFrame operators (see README.md)."""
