"""Training-data operators: dedup, quality, extraction, secrets, search, sharding, tokens,
decontamination, passage chaining and archive audits.

Nothing else in the package imports this subpackage; its registered queries live in
``llm.registry``.
"""
