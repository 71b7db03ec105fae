"""Dictionaries of phrases: one automaton for all, walked once over a text.

A regular expression of alternatives tries each at every place of a text; the
automaton takes one step a character, however many phrases there are. It is built
once a task from the phrases, which the caller counts: they go to every task.

A phrase stands where its characters stand, and by its kind of edge: ``anywhere``;
``word``, where a word of ASCII letters, digits and _ begins or ends at both sides,
as \\b of regular expressions says; ``token``, between white space or ends.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("anywhere", "word", "token")
#: Most phrases of a dictionary that goes to every task.
MAX_PHRASES = 1_000_000
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_SPACE = frozenset(" \t\n\x0b\f\r")


class PhraseDictionary:
    """Phrases with a label (an int) and a kind of edge; texts are matched as they stand, so lower both for any case."""

    def __init__(self, phrases: Iterable[tuple[str, int, str]]):
        merged: dict[str, list[tuple[int, str]]] = {}
        for phrase, label, edge in phrases:
            if edge not in EDGES:
                raise ValueError(f"unknown edge {edge}")
            if phrase and (label, edge) not in merged.setdefault(phrase, []):
                merged[phrase].append((label, edge))
        if len(merged) > MAX_PHRASES:
            raise ValueError(f"{len(merged)} phrases; join words of texts with a table of phrases instead")
        self.phrases = merged
        self.n_labels = len({label for own in merged.values() for label, _ in own})
        self._machine = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}  # tasks build their own

    def labels(self, text: str) -> list[int]:
        """The labels of the phrases that stand in ``text``, sorted; no further step once all labels are found."""
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for phrase, own in self.phrases.items():
                self._machine.add_word(phrase, (len(phrase), own))
            self._machine.make_automaton()
        found: set[int] = set()
        if self.phrases:
            for last, (length, own) in self._machine.iter(text):
                for label, edge in own:
                    if label not in found and stands(text, last + 1 - length, last + 1, edge):
                        found.add(label)
                if len(found) == self.n_labels:
                    break
        return sorted(found)


def stands(text: str, start: int, end: int, edge: str) -> bool:
    """Whether both sides of text[start:end] are edges of the kind."""
    if edge == "anywhere":
        return True
    before, after = text[start - 1] if start else "", text[end] if end < len(text) else ""
    if edge == "token":
        return (not before or before in _SPACE) and (not after or after in _SPACE)
    return (before in _WORD) != (text[start] in _WORD) and (after in _WORD) != (text[end - 1] in _WORD)


def found_labels(text: Column, dictionary: PhraseDictionary) -> Column:
    """The labels of the phrases that stand in a text; null for null. Texts pass to Python in Arrow batches."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else dictionary.labels(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)
