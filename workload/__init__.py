"""Registered queries: each Spark callable next to the SQL that checks it."""
