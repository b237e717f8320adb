"""Queries over the given tables, their SQL counterparts, and a tool that compares both."""
