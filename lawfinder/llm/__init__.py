"""Training-data operators: extraction, archives, scoring, deduplication, mixing and sharding.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
