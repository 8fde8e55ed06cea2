"""Whole jobs, one function per command, and the registered queries."""
