"""Operators for preparing language-model training corpora; nothing else in tessera imports this."""
