"""Relational operators over documents, cells, paragraphs, profiles and evidence."""
