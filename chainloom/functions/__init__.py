"""Column expressions that mirror the scalar functions of the domain."""
