"""Many patterns against texts: one automaton of literals finds candidates, a regex is tried on these alone."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from re import _constants as S  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]
from re import error

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of Spark's bitmaps, and so the most terms of one pass.
BITS = 32_768


def lowered(text: str) -> str:
    """A-Z in lower case, all else as it is, as a regex without case takes it."""
    return text if text.islower() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _needed(nodes) -> set[str] | None:
    """Strings of which any match holds one, as long as can be; None if there are none."""
    found: list[set[str]] = []
    run = ""
    for op, arg in [*nodes, (None, None)]:
        if op is S.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append({lowered(run)})
            run = ""
        inner: set[str] | None = None
        if op is S.SUBPATTERN:
            inner = _needed(arg[3])
        elif op is S.BRANCH:
            each = [_needed(b) for b in arg[1]]
            inner = set().union(*each) if all(each) else None
        elif op in (S.MAX_REPEAT, S.MIN_REPEAT, S.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = _needed(arg[2])
        elif op is S.ATOMIC_GROUP:
            inner = _needed(arg)
        if inner:
            found.append(inner)
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def literals(pattern: str) -> set[str] | None:
    """Lower-case strings one of which stands in every text that the pattern matches; None where nothing is certain.

    Patterns that Python can't parse have none: such a rule is tried on every text.
    """
    try:
        return _needed(_parser.parse(pattern))
    except (error, OverflowError, RecursionError):
        return None


@lru_cache(maxsize=8)
def _automaton(words: tuple[tuple[str, tuple[int, ...]], ...]) -> ahocorasick.Automaton:
    """Built once in each worker."""
    a = ahocorasick.Automaton()
    for word, places in words:
        a.add_word(word, places)
    a.make_automaton()
    return a


def _words(of: Sequence[set[str] | None]) -> tuple[tuple[str, tuple[int, ...]], ...]:
    by: dict[str, list[int]] = {}
    for i, words in enumerate(of):
        for w in words or ():
            by.setdefault(w, []).append(i)
    return tuple((w, tuple(places)) for w, places in sorted(by.items()))


def _held(text: str, automaton: ahocorasick.Automaton) -> set[int]:
    found: set[int] = set()
    for _, places in automaton.iter(text) if len(automaton) else ():
        found.update(places)
    return found


def first_rule(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The value of the first rule (pattern, value) that matches without case, null if none does or the text is null.

    The automaton names the rules whose literals the text holds, in order; their patterns are tried in the JVM, so a
    text meets few patterns however many there are. No join, no shuffle; rows stay as they are, equal ones too.
    """
    need = [literals(p) for p, _ in rules]
    always = [i for i, n in enumerate(need) if not n]
    words = _words(need)

    def candidates(texts: pd.Series) -> pd.Series:
        a = _automaton(words)
        none: list = []
        found = (none if t is None else sorted({*always, *_held(lowered(t), a)}) for t in texts)
        return pd.Series([[{"pattern": rules[i][0], "value": rules[i][1]} for i in f] for f in found], index=texts.index, dtype=object)

    some = F.pandas_udf(candidates, "array<struct<pattern:string,value:string>>")(text)
    return F.get(F.filter(some, lambda r: F.rlike(text, F.concat(F.lit("(?i)"), r["pattern"]))), F.lit(0))["value"]


def held_terms(text: Column, terms: Sequence[str | None]) -> Column:
    """A bitmap of which terms, by place, the text holds: to be united by bitmap_or_agg and counted by bitmap_count."""
    if len(terms) > BITS:
        raise ValueError(f"more than {BITS:,} terms")
    words = _words([{t} if t else None for t in terms])
    empty = [i for i, t in enumerate(terms) if t == ""]

    def bits(text: str | None) -> bytes | None:
        if text is None:
            return None
        row = np.zeros(-(-len(terms) // 8) * 8, np.uint8)
        row[[*empty, *_held(text, _automaton(words))]] = 1
        return np.packbits(row, bitorder="little").tobytes()

    return F.udf(bits, "binary", useArrow=False)(text)
