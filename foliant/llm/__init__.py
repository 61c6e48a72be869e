"""Training-data operators: scans, mixing, search, extraction, dedup, packing, scoring and media.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers its queries only
where it can be imported.
"""
