"""Column functions: patterns, URLs, decoders, rendering."""
