"""Change-sets as streams."""
