"""Compositions of operators: the session, multi-step plans, the registered queries."""
