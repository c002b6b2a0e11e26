"""Keyed state over streams of tool results."""
