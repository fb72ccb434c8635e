"""Registered queries: the operators over the bridge tables, each with the SQL that it must equal where SQL can say it."""
