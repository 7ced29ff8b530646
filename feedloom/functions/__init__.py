"""Scalar functions: Column expressions over urls, texts and JSON, evaluated inside the JVM."""
