"""Streams: responses appended once each, and metrics kept up to date."""
