"""Registered queries, their stand-in inputs, and the SQL they are compared with."""
