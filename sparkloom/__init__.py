"""A PySpark-native text, rule and source-structure analytics engine."""
