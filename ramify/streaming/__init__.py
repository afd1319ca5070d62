"""Networks from a stream of parameter rows."""
