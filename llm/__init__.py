"""Operators for preparing training data at scale; nothing else in this repository imports this package."""
