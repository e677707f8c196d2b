"""Files, byte windows, spans, saved tables."""
