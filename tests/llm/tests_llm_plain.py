"""Plain versions of two stages, for the pipeline's test."""

from test_decontamination import brute as decontaminate
from test_neardup import brute as plain_groups

__all__ = ["plain_contaminated", "plain_groups"]


def plain_contaminated(text, items):
    return decontaminate([(0, text)], items)[0][-1]
