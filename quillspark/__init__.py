"""quillspark: a PySpark-native content-intelligence engine."""
