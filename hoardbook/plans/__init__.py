"""The registered queries: how the given tables play the collections' part, and what runs."""
