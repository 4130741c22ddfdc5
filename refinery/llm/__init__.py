"""Training-data operators: dedup, packing, decontamination, scans, token files, scoring, archives.

Nothing else in the library imports this subpackage.
"""
