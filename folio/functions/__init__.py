"""Column functions: native expressions, and SQL names for what needs the kernel."""
