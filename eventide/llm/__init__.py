"""Training-corpus operators: dedup, packing, scoring, classifiers, archives.

Nothing outside this subpackage imports it.
"""
