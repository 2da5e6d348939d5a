"""functions of textloom."""
