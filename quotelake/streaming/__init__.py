"""streaming of quotelake."""
