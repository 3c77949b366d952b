"""Newsloom's plans."""
