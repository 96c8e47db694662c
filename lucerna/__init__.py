"""Spark-native document hygiene: findings, verdicts, redaction, cleaning and verification."""
