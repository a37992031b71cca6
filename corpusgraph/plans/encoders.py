"""A small encoder for the registered queries: any function from texts to vectors takes its place."""

from __future__ import annotations


class LetterCounts:
    """How often some characters stand in a text."""

    loads = 0

    def __init__(self, letters: str = "aeiou .,"):
        type(self).loads += 1
        self.letters = letters

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(c)) for c in self.letters] for t in texts]


def load_letter_counts() -> LetterCounts:
    return LetterCounts()
