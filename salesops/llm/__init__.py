"""Operators for large-scale training-data pipelines.

One module per operator, each with a general interface, plus ``queries.py``
(the registered ``opN_<name>`` queries over the given tables). Nothing outside
this package imports it.
"""
