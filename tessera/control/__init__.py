"""Policies, placement, transactions, packs, service."""
