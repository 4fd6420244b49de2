"""Registered queries over the test tables, each with an independent SQL twin where one exists."""
