"""Operators for training-data problems tagged llm. Nothing outside this folder imports it."""
