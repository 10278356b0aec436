"""Operators for large training-data corpora. Nothing else in kairospark imports this subpackage."""
