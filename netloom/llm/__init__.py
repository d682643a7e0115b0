"""Operators for preparing language-model training data. Nothing else in netloom imports this subpackage."""
