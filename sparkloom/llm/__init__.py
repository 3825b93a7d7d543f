"""Operators for training-data pipelines.

Self-contained: nothing else in the library imports this subpackage.  Each module
holds one operator with a general interface; :mod:`sparkloom.llm.registry` holds the
thin registered queries.
"""
