"""Readers, table contracts, typed projection of text, and validated writes."""
