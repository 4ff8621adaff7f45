"""engram: a PySpark engine for agent memory and for the data around it."""
