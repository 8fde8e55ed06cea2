"""Tests of the engine."""
