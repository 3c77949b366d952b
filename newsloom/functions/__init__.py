"""Newsloom's functions."""
