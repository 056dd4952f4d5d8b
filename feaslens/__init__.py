"""feaslens: Spark-native scenario analytics (samples, risk features, labels, splits, metrics, inference, audits)."""

__version__ = "0.1.0"
