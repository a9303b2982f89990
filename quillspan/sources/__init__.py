"""Text files in and out."""
