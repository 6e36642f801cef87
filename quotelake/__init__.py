"""quotelake: quotation and procurement analytics as Spark DataFrame operators."""
