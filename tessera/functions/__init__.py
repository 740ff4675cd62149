"""Column expressions: vectors, segments and the scalar rules of the protocol."""
