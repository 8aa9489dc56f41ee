"""Corpus readers, the model store and the scratch tables."""
