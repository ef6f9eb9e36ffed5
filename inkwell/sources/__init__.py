"""Readers: bytes of office, web, delimited and page files to a document model."""
