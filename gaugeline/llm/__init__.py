"""Training-data operators: mixing, search, dedup, quality, extraction, tokens, secrets, shards and licences.

Nothing outside this folder imports it. Each module holds one operator with its
own general interface; ``queries`` derives the registered results from them.
"""
