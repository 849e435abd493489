"""Column builders: small scalar functions used inside plans."""
