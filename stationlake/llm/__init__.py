"""Operators that prepare text corpora for training language models.

Nothing outside this folder imports it.  Each module holds one operator and the
query ``opN_<name>`` that applies it to its whole test table.
"""
