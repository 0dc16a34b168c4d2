"""Registered queries and the views over the test tables that they read."""
