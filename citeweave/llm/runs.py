"""Periodic run detection: a suffix automaton whose link tree is read by link-cut access.

A run is a stretch of consecutive words with smallest period q that holds at least two
periods and cannot grow to either side. The words of a text are appended one by one to a
suffix automaton; the suffix links form a tree in which the path from the root to the node
of a prefix holds all suffixes of that prefix. Each node remembers where its strings ended
last. Appending word i recolours the whole path with i (link-cut ``access``); the path falls
into segments of one former colour e, and a segment whose longest string is at least i - e
words long is a square: that string ends at e and at i, so the stretch from its first word
at e up to i has period i - e. Every square of a primitive word shows up that way, as its
second half ended last exactly one period ago, and the period found is the smallest one, as
a smaller one would have left a later colour. The longest string of a segment reaches back as
far as the period holds; to the right a square is extended word by word, once for each run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm.common import mix64, out_schema, slices

#: Words known to a task before it starts a new word list.
VOCABULARY = 1 << 20


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, longest lengths and the node of each prefix; node 1 is the root, 0 stands for none."""
    link, longest = [0, 0], [0, 0]
    step: list[dict[int, int]] = [{}, {}]
    prefix = []
    last = 1
    for w in words:
        new = len(link)
        link.append(1)
        longest.append(longest[last] + 1)
        step.append({})
        at = last
        while at and w not in step[at]:
            step[at][w] = new
            at = link[at]
        if at:
            to = step[at][w]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                twin = len(link)
                link.append(link[to])
                longest.append(longest[at] + 1)
                step.append(dict(step[to]))
                while at and step[at].get(w) == to:
                    step[at][w] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
        prefix.append(new)
    return link, longest, prefix


class LastEnds:
    """The link tree as preferred paths in splay trees; every path has one colour, kept at its splay root.

    The colour of a path is the last position at which its strings ended, or -1.
    """

    def __init__(self, link: list[int]) -> None:
        self.left = [0] * len(link)
        self.right = [0] * len(link)
        self.above = link[:]  # within a path the splay parent, at a splay root the node above the path
        self.colour = [-1] * len(link)

    def splay(self, x: int) -> None:
        """Make ``x`` the root of its splay tree; the colour moves from root to root."""
        left, right, above, colour = self.left, self.right, self.above, self.colour
        while True:
            p = above[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = above[p]
            if not g or (left[g] != p and right[g] != p):
                turns = (x,)
            elif (left[g] == p) == (left[p] == x):
                turns = (p, x)
            else:
                turns = (x, x)
            for y in turns:
                z = above[y]
                over = above[z]
                if left[z] == y:
                    child = left[z] = right[y]
                    right[y] = z
                else:
                    child = right[z] = left[y]
                    left[y] = z
                if child:
                    above[child] = z
                if over and left[over] == z:
                    left[over] = y
                elif over and right[over] == z:
                    right[over] = y
                else:
                    colour[y] = colour[z]
                above[z] = y
                above[y] = over

    def access(self, node: int, now: int) -> list[tuple[int, int]]:
        """Recolour the path from the root to ``node`` with ``now``; (deepest node, former colour) of its segments."""
        right, above, colour = self.right, self.above, self.colour
        found = []
        below, x = 0, node
        while x:
            self.splay(x)
            found.append((x, colour[x]))
            if right[x]:
                colour[right[x]] = colour[x]
            right[x] = below
            below, x = x, above[x]
        colour[below] = now
        return found


def runs_of(words: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least ``least`` words, by start and period."""
    link, longest, prefix = automaton(words)
    ends = LastEnds(link)
    n = len(words)
    reach: dict[int, int] = {}  # by period: where its latest run ends
    out = []
    for i, node in enumerate(prefix):
        for deepest, before in ends.access(node, i):
            period = i - before
            if before < 0 or period > longest[deepest] or reach.get(period, 0) > i:
                continue
            stop = i + 1
            while stop < n and words[stop] == words[stop - period]:
                stop += 1
            reach[period] = stop
            start = i + 1 - period - longest[deepest]
            if stop - start >= least:
                out.append((start, stop - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, begins: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The stretches (from, to) of a row of texts that may hold a run; all other words are in none.

    The first and the last part of a run that are equal to one another hold at least
    ``least / 2`` words each and cover it together. So every word of a run lies in a
    gram of that width which the same run repeats with nothing but such words in
    between. Grams of one text that recur are looked up, those with other words in
    between go, and this repeats while any go. ``begins`` are the first words of the
    texts; none of them may be empty.
    """
    width = max(1, (least + 1) // 2)
    n = len(words)
    if n < least:
        return []
    text = np.zeros(n, dtype=np.int64)
    text[begins[1:]] = 1
    text = np.cumsum(text)
    at = np.arange(n - width + 1)
    at = at[text[at] == text[at + width - 1]]
    h = text[at].astype(np.uint64)
    for j in range(width):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[at + j].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    while True:
        step = np.zeros(n + 1, dtype=np.int64)
        for ends in (a, b):
            np.add.at(step, ends, 1)
            np.add.at(step, ends + width, -1)
        covered = np.cumsum(step[:-1]) > 0
        bare = np.concatenate(([0], np.cumsum(~covered)))
        good = bare[b + width] == bare[a]
        if good.all():
            break
        a, b = a[good], b[good]
    first = covered.copy()
    first[1:] &= ~covered[:-1] | (text[1:] != text[:-1])
    last = covered.copy()
    last[:-1] &= ~covered[1:] | (text[1:] != text[:-1])
    return [(f, t + 1) for f, t in zip(np.flatnonzero(first).tolist(), np.flatnonzero(last).tolist(), strict=True) if t + 1 - f >= least]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words, without those that stand after the first period of any run, joined by blanks."""
    if runs:
        step = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            step[start + period] += 1
            step[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
    return b" ".join(words).decode("utf-8")


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs of at least ``least`` words of every whole text.

    Words stand between the six ASCII white-space characters and are numbered from 0.
    ``runs`` holds (start, length, period) by start, then period; ``collapsed`` is the
    text without the words after the first period of any run, joined by one blank. A
    null or empty text, or one of white space, has no words, no runs and an empty
    ``collapsed``. Rows are worked on one by one: null ids, repeated rows and ties pass
    through, an empty table gives no rows, other columns are ignored. A text is bounded
    only by the memory of one task.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        for batch in slices(batches):
            if len(known) > VOCABULARY:
                known.clear()
            words = [(t or "").encode("utf-8").split() for t in batch.column("text").to_pylist()]
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            edges = np.concatenate(([0], np.cumsum(sizes)))
            numbers = np.fromiter((known[w] for own in words for w in own), dtype=np.int64, count=edges[-1])
            found: list[list[tuple[int, int, int]]] = [[] for _ in words]
            for start, stop in stretches(numbers, edges[:-1][sizes > 0], least):
                row = int(np.searchsorted(edges, start, side="right")) - 1
                shift = start - int(edges[row])
                found[row] += [(s + shift, length, p) for s, length, p in runs_of(numbers[start:stop].tolist(), least)]
            flat = np.array([r for own in found for r in own], dtype=np.int64).reshape(-1, 3)
            offsets = np.concatenate(([0], np.cumsum([len(own) for own in found]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes),
                 pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([flat[:, 0], flat[:, 1], flat[:, 2]], fields=list(kind))),
                 pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    schema = out_schema(narrow, ["doc_id"], n_words=T.LongType(), runs=T.ArrayType(T.StructType(
        [T.StructField(f.name, T.LongType()) for f in kind])), collapsed=T.StringType())
    return narrow.mapInArrow(walk, schema)
