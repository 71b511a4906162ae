"""Comparison of unordered results."""


def same_rows(a, b):
    return sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)
