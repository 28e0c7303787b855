"""Which of many words a text holds, found in one pass.

The words become one pattern shaped like their trie, looked for at every place without consuming text. At a place only
the longest word is reported; all other words that begin there are beginnings of it, which is known
beforehand. So the pass costs about the same for ten words as for hundreds, and overlapping words are all seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _escaped(char: str) -> str:
    return re.escape(char) if char.isascii() else char


def trie_pattern(words: Iterable[str]) -> str:
    """A pattern for the longest of ``words`` at a place."""
    trie: dict = {}
    for word in words:
        node = trie
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def shape(node: dict) -> str:
        branches = [_escaped(char) + shape(below) for char, below in sorted(node.items()) if char]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return body + "?" * ("" in node)

    return shape(trie)


class WordSet:
    """Words that several rules ask for; a text is searched once for all of them."""

    def __init__(self, words: Iterable[str]):
        self.words = tuple(sorted(set(words)))
        if "" in self.words:
            raise ValueError("an empty word is in every text")
        firsts = "".join(sorted({_escaped(w[0]) for w in self.words}))
        self.pattern = f"(?=[{firsts}])(?=({trie_pattern(self.words)}))" if self.words else None

    def found(self, text: Column) -> Column:
        """The longest word at each place of ``text`` that has one, each once; null for a null text."""
        if self.pattern is None:
            return F.when(text.isNotNull(), F.array().cast("array<string>"))
        return F.array_distinct(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(1)))

    def holds_any(self, found: Column, words: Iterable[str]) -> Column:
        """Does a text whose ``found`` words are given hold one of ``words`` (some of this set's)?"""
        words = tuple(words)
        telling = [w for w in self.words if any(w.startswith(x) for x in words)]
        return F.arrays_overlap(found, F.array(*[F.lit(w) for w in telling])) if telling else F.lit(False)
