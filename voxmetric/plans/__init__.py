"""Whole-table plans: demo bindings, the query catalogue and its SQL twins."""
