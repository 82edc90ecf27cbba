"""Composed plans: the driver-table bindings, the product builders and the query catalogue."""
