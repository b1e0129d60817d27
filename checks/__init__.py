"""Queries over the driver tables, one per operator, with the SQL they are compared with."""
