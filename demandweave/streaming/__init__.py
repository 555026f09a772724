"""Incremental pick-up of landed months."""
