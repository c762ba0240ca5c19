"""Queries over the driver's tables, one per operator family, and their SQL counterparts."""
