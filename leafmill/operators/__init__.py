"""Relational operators over documents, sections, chunks, vectors and queries."""
