"""colscope: PySpark-native profiling of relational schemas from data-dictionary metadata."""
