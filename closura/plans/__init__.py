"""Rules and profiles."""
