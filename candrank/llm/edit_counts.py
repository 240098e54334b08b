"""Token counts that follow edits.

Each document is a list of leaves, runs of spans that no match of the vocabulary's pattern
reaches across, under a segment tree of (characters, tokens) sums. An edit finds its leaves
by character position, takes them together with one neighbour on either side, cuts the new
text into spans again, encodes only the spans it has not met, and puts the sums of the
changed leaves up to the root. The total is read at the root.

Edits are rows (doc_id, seq, start, length, insert) and apply in the order of ``seq``, each to
the text that the ones before it left; positions are code points from 0.

Defined results: a null or empty text has no tokens; a start or an end beyond the text is
moved to its end, a negative or null start to 0, a negative or null length to 0; a null insert
is empty; an edit without a document is ignored; repeated rows of a document each take all its
edits, repeated edits apply once each; a null doc_id takes no edits; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candrank.llm.tokens import _Memory, rank_encoding, spans

LEAF_SPANS = 64
_OUT = (
    "doc_id long, n_tokens long, n_edits int, edited_n_tokens long, edited_n_chars long, "
    "encoded_chars long, edited_sha256 string"
)


class CountTree:
    """Sums of characters and tokens over leaves, in a binary tree kept as two lists."""

    def __init__(self, text: str, count):
        self._count = count
        own = spans(text)
        self.leaves = [own[i : i + LEAF_SPANS] for i in range(0, len(own), LEAF_SPANS)] or [[]]
        width = 1
        while width < len(self.leaves):
            width *= 2
        self._width = width
        self._chars, self._tokens = [0] * (2 * width), [0] * (2 * width)
        for i, leaf in enumerate(self.leaves):
            self._chars[width + i] = sum(map(len, leaf))
            self._tokens[width + i] = sum(map(count, leaf))
        for i in range(width - 1, 0, -1):
            self._chars[i] = self._chars[2 * i] + self._chars[2 * i + 1]
            self._tokens[i] = self._tokens[2 * i] + self._tokens[2 * i + 1]
        self.encoded_chars = 0

    @property
    def n_tokens(self) -> int:
        return self._tokens[1]

    @property
    def n_chars(self) -> int:
        return self._chars[1]

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position, and where it begins."""
        node, before = 1, 0
        while node < self._width:
            node *= 2
            if position - before >= self._chars[node] and self._chars[node + 1]:
                before += self._chars[node]
                node += 1
        return node - self._width, before

    def _put(self, leaf: int, held: list[str]) -> None:
        self.leaves[leaf] = held
        node = self._width + leaf
        chars = sum(map(len, held)) - self._chars[node]
        tokens = sum(map(self._count, held)) - self._tokens[node]
        while node:
            self._chars[node] += chars
            self._tokens[node] += tokens
            node //= 2

    def edit(self, start: int, length: int, insert: str) -> None:
        n = self.n_chars
        start = min(max(start, 0), n)
        length = min(max(length, 0), n - start)
        first, before = self._leaf_at(start)
        last, _ = self._leaf_at(start + length)
        # One full neighbour on either side holds the context of a border.
        while first > 0:
            first -= 1
            if self.leaves[first]:
                before -= sum(map(len, self.leaves[first]))
                break
        while last + 1 < len(self.leaves):
            last += 1
            if self.leaves[last]:
                break
        touched = [span for leaf in self.leaves[first : last + 1] for span in leaf]
        # Only the spans around the edit are cut again.
        at, a = before, 0
        while a < len(touched) and at + len(touched[a]) < start:
            at += len(touched[a])
            a += 1
        end, b = at, a
        while b < len(touched) and end <= start + length:
            end += len(touched[b])
            b += 1
        a, b, at = (a - 1, min(b + 1, len(touched)), at - len(touched[a - 1])) if a else (
            a,
            min(b + 1, len(touched)),
            at,
        )
        region = "".join(touched[a:b])
        region = region[: start - at] + insert + region[start - at + length :]
        self.encoded_chars += len(region)
        held = touched[:a] + self._cut(region, a > 0) + touched[b:]
        share = max(1, -(-len(held) // (last - first + 1)))
        for i in range(first, last + 1):
            k = (i - first) * share
            self._put(i, held[k : k + share])

    @staticmethod
    def _cut(region: str, inside: bool) -> list[str]:
        """Spans of the region; inside a text its first span keeps its leading space."""
        if inside and region[:1] == " " and region[1:2].strip():
            own = spans(region[1:])
            return [" " + own[0], *own[1:]]
        return spans(region)

    def text(self) -> str:
        return "".join(span for leaf in self.leaves for span in leaf)


def count_edited(docs: DataFrame, edits: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row of ``docs``: its tokens before and after its edits, and the edited text's digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = rank_encoding(ranks_path, pattern)
        memory = _Memory(lambda span: len(one.encode_ordinary(span)))
        for pdf in batches:
            rows = []
            for doc_id, text, todo in zip(pdf["doc_id"], pdf["text"], pdf["edits"], strict=True):
                tree = CountTree(text or "", memory.__getitem__)
                before, todo = tree.n_tokens, [] if todo is None else list(todo)
                for step in todo:
                    tree.edit(int(step["start"]), int(step["length"]), step["insert"])
                digest = hashlib.sha256(tree.text().encode()).hexdigest()
                rows.append(
                    (doc_id, before, len(todo), tree.n_tokens, tree.n_chars, tree.encoded_chars, digest)
                )
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in _OUT.split(", ")])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    zero = F.lit(0).cast("long")
    steps = (
        edits.select(
            F.col("doc_id").cast("long").alias("__edited"),
            F.struct(
                F.col("seq").cast("long").alias("seq"),
                F.coalesce(F.col("start").cast("long"), zero).alias("start"),
                F.coalesce(F.col("length").cast("long"), zero).alias("length"),
                F.coalesce(F.col("insert").cast("string"), F.lit("")).alias("insert"),
            ).alias("step"),
        )
        .filter("__edited is not null")
        .groupBy("__edited")
        .agg(F.sort_array(F.collect_list("step")).alias("edits"))
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (
        own.join(steps, F.col("doc_id") == F.col("__edited"), "left")
        .select("doc_id", "text", "edits")
        .mapInPandas(run, _OUT)
    )
