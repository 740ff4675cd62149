"""Training-data operators over a ``documents`` table.

Nothing outside this subpackage imports it.  ``tessera.llm.queries`` holds the
registered queries; each operator has a module of its own.
"""
