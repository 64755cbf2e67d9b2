"""Operators on text for corpora: copies in different dress, token ids, mixtures, shared passages."""
