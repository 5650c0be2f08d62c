"""Operators on cells, words, lines and parts."""
