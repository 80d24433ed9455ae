"""Whole plans: building the database from dumps, and the lookup API over it."""
