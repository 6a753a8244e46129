"""Column functions on texts, bytes and sizes."""
