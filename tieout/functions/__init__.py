"""Column expressions. Everything here builds native Spark expressions; nothing runs Python per row."""
