"""Operators for text that feeds language models. Nothing outside this folder imports it."""
