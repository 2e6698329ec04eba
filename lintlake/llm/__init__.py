"""Training-data operators: de-duplication, extraction, scoring, scanning, packing.

Nothing outside this folder imports it; the rest of the library works without it.
"""
