"""Operators for preparing training text: near copies, repeats, language, quality, packing."""
