"""Column functions and explicit schemas."""
