"""Operators over signed frames, in their batch form."""
