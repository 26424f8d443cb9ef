"""Training-data operators: language, privacy, near copies, mixing, tokens.

Nothing outside this folder imports it; its queries live in
``stoich.llm.queries`` and are added by ``__spark_entry__`` when present.
"""
