"""Composed jobs (weekly feedback, re-draft) and the named query catalog."""
