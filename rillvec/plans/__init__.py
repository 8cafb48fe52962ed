"""Helpers that shape plans: durable intermediate tables and sessions."""
