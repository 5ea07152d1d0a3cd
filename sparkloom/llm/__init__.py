"""Operators that prepare training data for language models, on Spark. Nothing else in the library imports this."""
