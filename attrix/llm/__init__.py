"""Training-data operators over documents; nothing outside this package imports it."""
