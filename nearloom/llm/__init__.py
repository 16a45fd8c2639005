"""Operators for preparing training corpora (text, web pages, archives, embeddings).

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`nearloom.llm.queries` derives the contract
queries from them.
"""
