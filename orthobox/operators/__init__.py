"""Distributed box operators: range, nearest-neighbour, joins, index build and index metrics."""
