"""Substring dedup (operator 9): remove words covered by a window of W words that occurs anywhere else.

The reference is the corpus itself, so its automata grow with the input and are not broadcast whole: ``repeats`` cuts
the reference into shards by anchor, settles segments that are identical, and sends each shard only the segments that
differ. There a suffix automaton of the shard is built, the segments are streamed through it for matching statistics
(the longest suffix read so far that occurs twice), and maximal spans of W words or more are returned.

Nulls: a null text has no words. Repeated ids are separate rows, and so repeat one another; of equal texts (ties) all
lose their windows. An empty table gives an empty result. Texts of any length are read whole; a task holds one long
text and its hashes. Columns named n_words, n_removed or kept are replaced, any other name may occur.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strata.llm.common import keyed, rest_of
from strata.llm.repeats import Repeats, covered, group_starts, word_tokens
from strata.llm.suffix_dedup import with_ranges

WINDOW, GRAM = 35, 8


class Automaton:
    """Suffix automaton of several token sequences, with the number of occurrences of every state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, move: dict, link: int) -> int:
        self.next.append(move)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings that end in c and are no longer than p's and one."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, tokens: list[int]) -> None:
        last = 0
        for c in tokens:
            p, q = last, self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            else:
                last = self._state(self.length[p] + 1, {}, 0)
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            self.count[last] += 1

    def close(self) -> None:
        """Counts go up the links; then ``twice`` is each state's nearest that occurs twice."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]
        self.twice = [0] * len(self.length)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.twice[v] = v if self.count[v] > 1 else self.twice[self.link[v]]

    def statistics(self, tokens: list[int]) -> list[int]:
        """For every end, the length of the longest string ending there that occurs twice among the sequences added."""
        v, read, out = 0, 0, []
        for c in tokens:
            while v and c not in self.next[v]:
                v = self.link[v]
                read = self.length[v]
            if c in self.next[v]:
                v, read = self.next[v][c], read + 1
            t = self.twice[v]
            out.append(read if t == v else self.length[t])
        return out


def repeated_words(window: int, group, key, pos, segments) -> tuple[list, list, list]:
    out: tuple[list, list, list] = ([], [], [])
    cut = group_starts(group)
    for s, e in itertools.pairwise(cut.tolist()):
        if e - s < 2 and len(segments[s]) <= window:
            continue
        automaton, tokens = Automaton(), [x.tolist() for x in segments[s:e]]
        for t in tokens:
            automaton.add(t)
        automaton.close()
        for m, t in enumerate(tokens):
            ends = [i + 1 for i, n in enumerate(automaton.statistics(t)) if n >= window]
            start = stop = None
            for z in ends:
                if stop is not None and z - window <= stop:
                    stop = z
                    continue
                if stop is not None:
                    _put(out, key[s + m], pos[s + m] + start, pos[s + m] + stop)
                start, stop = z - window, z
            if stop is not None:
                _put(out, key[s + m], pos[s + m] + start, pos[s + m] + stop)
    return out


def _put(out, *row) -> None:
    for column, value in zip(out, row, strict=True):
        column.append(int(value))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All columns of docs, then (n_words, n_removed, kept): per row; kept is the remaining words joined by a space.

    Columns of docs named like the last three are replaced; any other name may occur.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), rest_of(names, text)), "id", "text")
    repeats = Repeats(window, gram, False, word_tokens, partial(repeated_words, window))

    def run(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            ranges = b.column(b.num_columns - 1)
            for d, t in enumerate(b.column(b.num_columns - 2).to_pylist()):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                gone = 0
                if ranges[d].is_valid:
                    start, stop = covered(*(ranges[d].values.field(f).to_numpy() for f in (0, 1)))
                    gone = int((stop - start).sum())
                    for s, e in zip(start[::-1].tolist(), stop[::-1].tolist(), strict=True):
                        del words[s:e]
                n_removed.append(gone)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["own", "text", "n_words", "n_removed", "kept"])

    marked = with_ranges(rows, repeats).select("own", "text", "r")
    more = [StructField(c, t) for c, t in (("text", StringType()), ("n_words", LongType()), ("n_removed", LongType()), ("kept", StringType()))]
    out = marked.mapInArrow(run, StructType([marked.schema["own"], *more]))
    return out.select(*[F.col("text").alias(c) if c == text else F.col("own").getField(c).alias(c) for c in names], "n_words", "n_removed", "kept")
