"""Tests of the llm subpackage."""
