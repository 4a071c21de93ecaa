"""Edit-aware token counts (operator 8).

A text is split into pre-tokens, which the tokenizer encodes one by one.  A document's
state is a segment tree over leaves of ``LEAF`` pre-tokens; every node has the characters
and tokens below it.  An edit replaces a range of characters: the tree is descended to the
leaf where re-splitting must begin (a pre-token depends on two characters after it at
most, so the leaf that holds the place two before the edit), the new text is split from
there until a boundary falls on an old leaf's again, only those pre-tokens are encoded,
and the sums on the paths above are updated.

Cases: null or empty text has no tokens and can be edited; edits are applied in order, to
the text as the earlier ones left it; ranges are clipped to the text; an edit that
changes nothing re-encodes its leaf only; repeated rows are counted alike; extra columns
are not read.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import LEAVING, lean

LEAF = 64
KEPT = 1_000_000  # pre-tokens whose counts a worker remembers

#: What the byte-level tokenizer splits by (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GENERAL = regex.compile(PATTERN)
#: The same for texts of printable ASCII, letters of Latin-1 and line ends.
L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[0-9]+| ?[^\s0-9{L}]+|\s+(?!\S)|\s+")
OTHER = re.compile("[^\t\n\r -~¡-¬®-±´-¸º»¿-ÿ]")


def splitter(text: str):
    return GENERAL if OTHER.search(text) else LATIN


class Counter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are ordinary text
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > KEPT:
            known.clear()
        new = list(set(parts).difference(known))
        if new:
            known.update((w, len(e.ids)) for w, e in zip(new, self.library.encode_batch(new, add_special_tokens=False), strict=True))
        return list(map(known.__getitem__, parts))


@lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(path)


LEAVING.append(counter.cache_clear)


class Tree:
    """``chars`` and ``tokens`` in heap order: node 1 is the root, leaves follow."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.build(chars, tokens)

    def build(self, chars: list[int], tokens: list[int]) -> None:
        self.n = len(chars)
        self.width = 1 << max(0, (self.n - 1).bit_length())
        self.chars = [0] * self.width + chars + [0] * (self.width - self.n)
        self.tokens = [0] * self.width + tokens + [0] * (self.width - self.n)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds this character, and where the leaf begins."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if place >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def leaves(self, kind: list[int]) -> list[int]:
        return kind[self.width : self.width + self.n]

    def replace(self, a: int, b: int, chars: list[int], tokens: list[int]) -> None:
        """Leaves a to b by others; as many, and only their paths change."""
        if b - a == len(chars):
            todo = set()
            for i, (c, t) in enumerate(zip(chars, tokens, strict=True), a):
                self.chars[self.width + i], self.tokens[self.width + i] = c, t
                todo.add((self.width + i) // 2)
            while todo:
                todo.discard(0)
                for i in todo:
                    self._sum(i)
                todo = {i // 2 for i in todo if i > 1}
            return
        c, t = self.leaves(self.chars), self.leaves(self.tokens)
        self.build(c[:a] + chars + c[b:], t[:a] + tokens + t[b:])


def leaves_of(parts: list[str], counts: list[int]) -> tuple[list[int], list[int]]:
    return [sum(map(len, parts[i : i + LEAF])) for i in range(0, len(parts), LEAF)], [sum(counts[i : i + LEAF]) for i in range(0, len(parts), LEAF)]


def counted(text: str, tool: Counter) -> tuple[Tree, int]:
    """The tree of a text, and its pre-tokens."""
    parts = splitter(text).findall(text)
    return Tree(*leaves_of(parts, tool.counts(parts))), len(parts)


def edited(tree: Tree, text: str, start: int, end: int, new: str, tool: Counter) -> tuple[str, int]:
    """The text after an edit, with the tree brought up to it, and how many pre-tokens
    were encoded."""
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    after = text[:start] + new + text[end:]
    shift = len(new) - (end - start)
    if not text:
        parts = splitter(after).findall(after)
        tree.build(*leaves_of(parts, tool.counts(parts)))
        return after, len(parts)
    first, at = tree.leaf_at(max(0, start - 2))
    # old leaf boundaries behind the edit, in places of the new text
    last, low = tree.leaf_at(end)
    place, leaf = low, last
    chars = tree.chars
    split = splitter(after)
    parts: list[str] = []
    stop = tree.n
    for m in split.finditer(after, at):
        while leaf < tree.n and place + shift < m.start():
            place += chars[tree.width + leaf]
            leaf += 1
        if m.start() == place + shift and place >= end and parts and leaf < tree.n:
            stop = leaf
            break
        parts.append(m.group())
    c, t = leaves_of(parts, tool.counts(parts))
    tree.replace(first, stop, c, t)
    return after, len(parts)


EDIT = "array<struct<start: long, end: long, text: string>>"


def count(rows: DataFrame, path: str) -> DataFrame:
    """From (doc_id, text, edits): doc_id, n_pretokens, n_tokens, n_tokens_after,
    n_reencoded (pre-tokens), tree_chars and tree_tokens after the edits."""

    def run(batches):
        tool = counter(path)
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n_pretokens", "n_tokens", "n_tokens_after", "n_reencoded", "tree_chars", "tree_tokens")}
            for text, edits in zip(batch.column("text"), batch.column("edits").to_pylist(), strict=True):
                text = text.as_py() or ""
                tree, n = counted(text, tool)
                before, again = tree.total, 0
                for e in edits or ():
                    text, k = edited(tree, text, e["start"] or 0, e["end"] or 0, e["text"] or "", tool)
                    again += k
                for k, v in zip(cols, (n, before, tree.total, again, tree.chars, tree.tokens), strict=True):
                    cols[k].append(v)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True)]], names=["doc_id", *cols])

    return rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("edits").cast(EDIT).alias("edits")).mapInArrow(
        lean(run), "doc_id long, n_pretokens long, n_tokens long, n_tokens_after long, n_reencoded long, tree_chars array<long>, tree_tokens array<long>"
    )
