"""Stages and their parts; every one takes and returns DataFrames."""
