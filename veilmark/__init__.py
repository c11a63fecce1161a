"""veilmark: a PySpark-native engine for finding, measuring and masking personal data."""
