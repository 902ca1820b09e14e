"""Streaming forms: state processors and runners."""
