"""Operators for text corpora and entity data; nothing outside this subpackage imports it."""
