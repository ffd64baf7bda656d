"""Source code to chunks, one table-valued function per language."""
