"""Filter documents, their compilation to one Column, and whole queries."""
