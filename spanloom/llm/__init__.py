"""Training-data operators (decontamination, extraction, quality, dedup, packing).

Nothing else in the library imports this subpackage.
"""
