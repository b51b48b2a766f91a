"""Part of terragrid."""
