"""Column expressions and skew-safe DataFrame helpers."""
