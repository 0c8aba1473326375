"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; :mod:`velarium.llm.queries` registers
the thin ``opN_<name>`` queries.
"""
