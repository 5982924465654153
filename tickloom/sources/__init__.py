"""Tables of bars, returns and trials derived from raw records."""
