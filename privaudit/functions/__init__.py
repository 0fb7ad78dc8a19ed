"""Column-level functions: built-in Spark expressions, plus one Arrow UDF for compressed payloads."""
