"""operators of quotelake."""
