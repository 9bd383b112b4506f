"""Bound plans as DataFrames: scans, filters, joins, grouping, order and output."""
