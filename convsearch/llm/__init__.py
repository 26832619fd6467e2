"""Operators for preparing training data: packing, toxicity, pseudonyms,
tokenising, sharding, similarity joins, quality rules, token files, main-text
extraction and nearest-neighbour search. Nothing outside imports this."""
