"""Operators that prepare text corpora: deduplication, filtering, scanning, mixing."""
