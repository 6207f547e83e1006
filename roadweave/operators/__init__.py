"""Operators from points and roads to matched routes and their evaluation, each a DataFrame in and out."""
