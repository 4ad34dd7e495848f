"""Registered queries: importing ``catalog`` fills the registry."""
