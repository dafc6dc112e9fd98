"""Registered queries and the statements they are checked against."""
