"""Relational operators over catalogues, text, vectors, identities and rules."""
