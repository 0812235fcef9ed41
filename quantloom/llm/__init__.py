"""Training-data operators: filtering, deduplication, scoring, formatting, mixing and packing.

Nothing outside this folder imports it; ``__spark_entry__`` registers its queries only when it is present.
"""
