"""Cairnkb: DataFrame operators for text knowledge bases, the questions asked of them and their usage."""
