"""Registered queries over the harness tables, and their SQL counterparts."""
