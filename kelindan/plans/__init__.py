"""Registered queries: each module binds operators to tables and states the same result in SQL."""
