"""Operators combined into reports and cycles."""
