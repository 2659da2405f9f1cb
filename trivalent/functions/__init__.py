"""Column functions of the catalogue: text, numbers, dates, urls, details."""
