"""Reading and writing case tables, audit tables and results."""
