"""Error-tolerant parsers that turn source text into flat node arrays."""
