"""Training-data operators: search, scoring, packing, cleaning, encoding and de-duplication of text.

Nothing outside this package imports it; ``queries`` holds the registered queries and their SQL.
"""
