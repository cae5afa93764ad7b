"""Training-data operators: dedup, decontamination, scoring, extraction, packing.

Nothing outside this subpackage imports it; its queries are registered by
``tidemark.llm.queries``.
"""
