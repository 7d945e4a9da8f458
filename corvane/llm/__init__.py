"""Training-data operators: tokenising, packing, deduplication, filtering and archives.

Nothing outside this subpackage imports it; the rest of the library works when
the folder is absent.
"""
