"""Operators on text corpora: filters, near duplicates, repeats, tokens and models trained from the corpus."""
