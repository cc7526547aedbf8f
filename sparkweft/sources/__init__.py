"""Readers: functions from paths to DataFrames."""
