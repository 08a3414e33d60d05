"""Operators on pools and result tables; every one takes and returns DataFrames."""
