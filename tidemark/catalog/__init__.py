"""The registered queries, each with its independent SQL twin."""
