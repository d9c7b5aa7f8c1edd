"""Where tables come from: versioned directories and imported files."""
