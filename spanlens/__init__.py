"""spanlens: span-audit analytics and training-data operators on Spark."""
