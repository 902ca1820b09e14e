"""Scalar and table functions as Column expressions."""

from ebbflow.functions.text import custom_format_to_iso, delay, iso_to_minute, json_path, length, lower, raise_when_equal, random_bag, strsplit, tokenize, try_text

__all__ = ["custom_format_to_iso", "delay", "iso_to_minute", "json_path", "length", "lower", "raise_when_equal", "random_bag", "strsplit", "tokenize", "try_text"]
