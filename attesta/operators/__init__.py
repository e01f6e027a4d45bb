"""Detectors and relational operators over ``cells`` and findings."""
