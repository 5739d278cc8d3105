"""Training-data operators: dedup, tokens, packing, URL rules, quality, similarity, search, shards, personal data, BPE, hard
negatives, licenses, conversations.

Nothing outside this subpackage imports it; the repository works with it removed.
"""
