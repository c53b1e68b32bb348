"""Column expressions: no UDFs, everything stays inside whole-stage code generation."""
