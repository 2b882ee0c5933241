"""Training-data operators: filtering, deduplication, token accounting, packing and sharding.

Nothing outside this folder imports it; its queries live in :mod:`ruleweave.llm.queries`.
"""
