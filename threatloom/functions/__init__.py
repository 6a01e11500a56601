"""Column functions: text, URL, address and risk expressions."""
