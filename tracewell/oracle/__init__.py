"""The same questions in DuckDB's SQL, written apart from the library's plans."""
