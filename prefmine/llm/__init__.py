"""Operators for large-scale training-data pipelines.

Thirteen operators, one module each, used by the registered ``opN_*`` queries in
:mod:`prefmine.llm.queries` and by ``corpus_pipeline.py``.  Nothing outside
this subpackage imports it.
"""
