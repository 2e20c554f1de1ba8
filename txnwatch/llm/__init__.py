"""Training-data operators and their pipeline; nothing else in the library imports this."""
