"""Operators that prepare text corpora for language-model training."""
