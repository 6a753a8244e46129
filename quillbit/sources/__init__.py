"""Files in and out: raw inputs, containers and restored files."""
