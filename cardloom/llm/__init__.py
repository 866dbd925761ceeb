"""Training-data operators: packing, decontamination, filtering, de-duplication and friends.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames.
"""
