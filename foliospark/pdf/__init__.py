"""PDF objects, reading and writing, on plain Python values."""
