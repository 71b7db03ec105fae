"""Operators for preparing language-model training data.

Self-contained: nothing outside this folder imports it, and deleting it leaves
the rest of the library working.
"""
