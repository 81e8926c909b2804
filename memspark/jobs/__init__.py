"""Maintenance jobs: transforms of tables into their next state; a second run changes nothing."""
