"""Operators for preparing training corpora: one module each, and their queries in `queries`."""
