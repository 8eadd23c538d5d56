"""Registered queries: each module pairs a DataFrame program with reference SQL."""
