"""Operators for preparing training text: cleaning, scoring, counting and de-duplicating
documents, pages and vectors. Nothing else in the library imports this subpackage."""
