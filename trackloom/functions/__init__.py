"""Column expressions: geometry and time. No UDFs, so they stay inside generated code."""
