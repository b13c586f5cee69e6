"""Shared by the tests of the training-data operators."""


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(r[c] for c in names) for r in frame.collect()), key=repr)
