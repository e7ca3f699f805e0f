"""Training-data operators: each module holds one operator as DataFrame-to-DataFrame functions.

Nothing outside this subpackage imports it; `attesta.llm.queries` lists the registered queries.
"""
