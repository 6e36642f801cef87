"""functions of quotelake."""
