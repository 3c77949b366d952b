"""Newsloom's operators."""
