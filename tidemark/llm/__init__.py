"""Operators for preparing training corpora. Nothing else in tidemark imports this subpackage."""
