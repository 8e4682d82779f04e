"""Column expressions: text, answers and vectors. All stay inside the JVM."""
