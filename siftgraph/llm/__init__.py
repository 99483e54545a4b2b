"""Training-data operators: whole-text scans over a document corpus.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries`` derives the registered digests from them.
"""
