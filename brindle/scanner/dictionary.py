"""Known words: a dictionary that is a parameter, and what a value's words say about it.

The default is small and made of the name lists that the engine has anyway; ``learned`` builds
a large one from any table of ordinary text, with a bounded size.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import names
from brindle.scanner import words
from brindle.sources.services import SERVICES


def default() -> frozenset[str]:
    lists = (names.KEY_QUALIFIERS, names.TOKEN_QUALIFIERS, names.EXCLUSIONS, names.DISQUALIFIERS, names.STRONG_KEYWORDS, names.KEY_DISQUALIFIERS, names.TOKEN_DISQUALIFIERS)
    return frozenset(w for own in lists for w in own) | frozenset(s[0] for s in SERVICES)


def learned(texts: DataFrame, text_col: str = "text", least: int = 20, most: int = 20_000) -> frozenset[str]:
    """The ``most`` most frequent words of five letters and more that ``least`` texts have at least."""
    found = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"\b[a-z]{5,}\b"), F.lit(0)))).alias("word"))
    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return frozenset(r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect())


class Dictionary:
    def __init__(self, known: frozenset[str] | None = None, events: frozenset[str] = frozenset()):
        import ahocorasick

        self.known, self.events = default() if known is None else known, events
        self.matcher = ahocorasick.Automaton()
        for w in self.known:
            if len(w) >= 3:
                self.matcher.add_word(w, len(w))
        self.matcher.make_automaton()

    def _covered(self, text: str) -> list[bool]:
        covered = [False] * len(text)
        for end, n in self.matcher.iter(text) if len(self.matcher) else ():
            covered[end - n + 1 : end + 1] = [True] * n
        return covered

    def known_words(self, value: str, local: tuple[str, ...] = ()) -> bool:
        """All words known, or three, or two with 60 % of the letters; a single word may be words run together."""
        parts = [w for part in re.split("[^A-Za-z0-9]", value) if part for w in words.camel_words(part)]
        parts = [p for p in parts if re.search("[a-z]", p)]
        if not parts:
            return False
        met = [p for p in parts if p in self.known or p in local]
        if len(met) == len(parts) or len(met) >= 3 or len(met) == 2 and sum(map(len, met)) >= 0.6 * sum(map(len, parts)):
            return True
        return len(parts) == 1 and self.run_together(parts[0])

    def run_together(self, word: str) -> bool:
        covered = self._covered(word)
        bare = [c for c, hit in zip(word, covered, strict=True) if not hit]
        if bare and 2 * sum(c.isdigit() for c in bare) > len(bare):
            return False
        return bool(word) and sum(covered) >= 0.6 * len(word)

    def identifier(self, value: str, lower: str) -> bool:
        """A value with separators whose letters are covered by known words to 45 %."""
        n = sum(c.isascii() and c.isalpha() for c in lower)
        return bool(n and re.search(r"[_\-./\\%(){}\[\]:]", value)) and sum(self._covered(lower)) >= 0.45 * n

    def long_word(self, lower: str) -> bool:
        """A known word of seven letters and more that makes up 40 % of the value."""
        return bool(len(self.matcher)) and any(n >= 7 and 5 * n >= 2 * len(lower.encode()) for _, n in self.matcher.iter(lower))
