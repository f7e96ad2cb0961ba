"""Operators for building language-model training corpora.

Self-contained: nothing outside this package imports it, and it imports nothing from the rest of the library.
"""
