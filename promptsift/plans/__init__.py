"""Funnels, profiles, and the registered queries."""
