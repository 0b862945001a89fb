"""Column functions: text, dates, geography, arrays, weekly hours, scores."""
