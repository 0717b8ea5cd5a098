"""Sales analytics and forecasting as Spark DataFrame operators."""
