"""Reading and writing: CSV, JSON lines, JSON arrays, text, paged services, checkpoints."""
