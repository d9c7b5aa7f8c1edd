"""Types, collations and functions of the SQL dialect."""
