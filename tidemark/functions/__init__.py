"""Column expressions: key codecs, hashes, names and estimates."""
