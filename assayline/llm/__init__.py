"""Corpus-preparation operators for training data; see README, section "Corpus operators"."""
