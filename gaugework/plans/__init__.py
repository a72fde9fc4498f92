"""Registered queries: each applies an operator to the driver's tables; most have the same result in SQL."""
