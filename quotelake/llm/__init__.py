"""Operators of a training-data pipeline; nothing else in quotelake imports this subpackage."""
