"""Spark-native analytics for payment-transaction risk."""
