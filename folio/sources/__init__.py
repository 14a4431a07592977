"""Where documents come from and go: files, tables, and documents composed of tables."""
