"""Operators for text corpora: names, damaged text, canonical values, tokens, containers, shared spans."""
