"""End-to-end plans made of operators."""
