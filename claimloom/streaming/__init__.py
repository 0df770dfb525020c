"""Subscriptions on a claim log that grows."""
