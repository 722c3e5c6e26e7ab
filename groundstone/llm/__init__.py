"""Operators for training data: duplicates, groups, neighbours, text forms, pieces, containers,
leaks and languages.  Nothing else in the library imports this subpackage."""
