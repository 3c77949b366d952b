"""Newsloom's streaming."""
