"""Readers, sinks and audit logs."""
