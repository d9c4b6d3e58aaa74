"""Reading and writing tables, files and event envelopes."""
