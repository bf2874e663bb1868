"""Training-data operators: ten dealt operators, their queries and their SQL.

Nothing outside this subpackage imports it; the engine works without it.
"""
