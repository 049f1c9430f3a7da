"""Training-data operators: dedup, decontamination, secrets, search, fixity, packing, language.

Nothing outside this subpackage imports it; ``queries.py`` holds its registered queries.
"""
