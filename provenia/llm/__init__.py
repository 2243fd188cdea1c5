"""Training-data operators: scoring, tokenising, de-duplication, search, sharding, filters.

Nothing outside this subpackage imports it; ``provenia.llm.registry`` lists its queries.
"""
