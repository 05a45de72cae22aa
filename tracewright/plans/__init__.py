"""Building blocks that keep plans even under skew."""
