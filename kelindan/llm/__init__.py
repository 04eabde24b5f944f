"""Operators for training data. Nothing outside this package imports it; it uses the core's session and components."""
