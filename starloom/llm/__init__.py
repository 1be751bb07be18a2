"""Training-data operators: filtering, near duplicates, pseudonyms, sharding, archives, tokens and packing.

Nothing outside this subpackage imports it.
"""
