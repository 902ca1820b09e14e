"""Sources of signed frames."""
