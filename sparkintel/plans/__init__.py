"""Plans of the triage engine."""
