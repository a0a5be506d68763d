"""Part of korvane."""
