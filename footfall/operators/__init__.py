"""Building blocks of the models."""
