"""The same cleaning and counting over arriving files."""
