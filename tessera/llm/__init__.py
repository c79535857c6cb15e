"""Operators for training-text corpora; nothing outside this subpackage imports it."""
