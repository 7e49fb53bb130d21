"""Training-data operators: dedup, search, mixing, filters, scoring, tokens, secrets.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; ``registry`` derives the registered ``opN_<name>`` queries.
"""
