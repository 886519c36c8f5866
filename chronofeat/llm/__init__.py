"""Operators for training corpora; nothing outside this folder imports it."""
