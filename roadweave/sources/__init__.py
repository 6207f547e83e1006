"""Readers and writers of points, routes, road networks, matches and reports."""
