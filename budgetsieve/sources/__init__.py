"""Readers, sinks and the pools that queries work on."""
