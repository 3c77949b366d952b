"""Newsloom's sources."""
