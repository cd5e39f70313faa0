"""Edit-aware token counts: a segment tree of pre-tokens for each document, re-encoded only where edits touch it.

Leaves are pre-tokens. Nodes hold the number of characters, pre-tokens and tokens below them, so an edit finds its place by going
down and passes its differences up. The pre-tokenizer reads from left to right and looks at most a few characters ahead. So
what ends some characters before an edit stays as it is, and once a new boundary behind the edit falls on an old one,
so does everything that follows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import documents, remembered, small_batches, whole_text

#: Fixed value: the pre-tokens of this tokenizer.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: blocks of letters. Of a text that has these and ASCII only, the standard library's engine finds the same pre-tokens sooner.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN_PRE_TOKEN = PRE_TOKEN.replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9").replace(f" ?{LETTERS}+", f" ?[{LETTERS}]+").replace(" ?0-9+", " ?[0-9]+")
#: Characters beyond its end that may decide where a pre-token ends.
AHEAD = 3
#: Pre-tokens in a leaf at most, and pre-tokens that a worker remembers before it starts afresh.
LEAF, REMEMBERED = 64, 1_000_000
#: Pre-tokens that are encoded in one text at most.
TOGETHER = 5_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PreTokenCounter:
    """Pre-tokens of a text, and the number of tokens of each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker is one of many: threads that wait for its next text take their cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pattern = regex.compile(PRE_TOKEN)
        self.plain, self.other = re.compile(PLAIN_PRE_TOKEN), re.compile(rf"[^\t-\r -~{LETTERS}]")
        self.apart, self.line_end = re.compile(r" ?\S+"), self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, int] = {}
        self.encoded = 0

    def pieces(self, text: str) -> list[str]:
        return (self.pattern if self.other.search(text) else self.plain).findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        """How many tokens each piece has; encoded counts the characters that were passed to the tokenizer or remembered."""
        self.encoded += sum(map(len, pieces))
        try:
            return list(map(self.known.__getitem__, pieces))
        except KeyError:
            self.learn(set(pieces))
            return list(map(self.known.__getitem__, pieces))

    def learn(self, pieces: set[str]) -> None:
        """Pre-tokens without white space but a space in front are encoded many at once, with line ends between them: these part
        them from one another and are in none of them."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(pieces.difference(self.known))
        for k in range(0, len(new), TOGETHER):
            some = new[k : k + TOGETHER]
            together = list(filter(self.apart.fullmatch, some))
            if together and len(self.line_end) == 1:
                ids = np.array(self._encoded(["\n".join(together)])[0].ids)
                counts = np.diff(np.flatnonzero(ids == self.line_end[0]), prepend=-1, append=len(ids)) - 1
                if len(counts) == len(together):
                    self.known.update(zip(together, counts.tolist(), strict=True))
            left = [x for x in some if x not in self.known]
            self.known.update(zip(left, [len(found.ids) for found in self._encoded(left)], strict=True))

    def _encoded(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)


def counter(path: str) -> PreTokenCounter:
    workers = remembered("token-counts")
    if path not in workers:
        workers[path] = PreTokenCounter(path)
    return workers[path]


class SegmentTree:
    """The pre-tokens of one document. leaf(k): a list of (pre-token, tokens), LEAF of them when built; chars, tokens: sums, the root at 1."""

    def __init__(self, text: str, counter: PreTokenCounter, pieces: list[str] | None = None):
        """pieces: the text's pre-tokens, if they are known."""
        self.counter = counter
        pieces = counter.pieces(text) if pieces is None else pieces
        self._build(pieces, counter.counts(pieces))

    def _build(self, pieces: list[str], counts: list[int]) -> None:
        self._pieces, self._counts = pieces, counts
        starts = np.arange(0, max(len(pieces), 1), LEAF)
        self.leaves: list[list[tuple[str, int]] | None] = [None] * len(starts)  # None: as it was built
        self.width = 1 << (len(starts) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        if pieces:
            self.chars[self.width : self.width + len(starts)] = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), starts)
            self.tokens[self.width : self.width + len(starts)] = np.add.reduceat(np.array(counts, np.int64), starts)
        for sums in (self.chars, self.tokens):
            level = self.width
            while level > 1:
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
                level //= 2

    def leaf(self, k: int) -> list[tuple[str, int]]:
        found = self.leaves[k]
        if found is None:
            part = slice(k * LEAF, (k + 1) * LEAF)
            found = self.leaves[k] = list(zip(self._pieces[part], self._counts[part], strict=True))
        return found

    def pieces(self) -> list[str]:
        out: list[str] = []
        for k, leaf in enumerate(self.leaves):
            out += self._pieces[k * LEAF : (k + 1) * LEAF] if leaf is None else [p for p, _ in leaf]
        return out

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(self.pieces())

    def count_before(self, at: int) -> int:
        """The tokens of the pre-tokens that begin before a place."""
        leaf, start, tokens = self._find(at)
        for piece, n in self.leaf(leaf):
            if start >= at:
                break
            start, tokens = start + len(piece), tokens + n
        return tokens

    def _find(self, at: int) -> tuple[int, int, int]:
        """The leaf that holds a place (the last at the end), where it starts, and the tokens before it."""
        node, start, tokens = 1, 0, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start, tokens, node = start + int(self.chars[node]), tokens + int(self.tokens[node]), node + 1
        return node - self.width, start, tokens

    def _set(self, leaf: int, items: list[tuple[str, int]]) -> None:
        self.leaves[leaf] = items
        node = self.width + leaf
        chars, tokens = sum([len(p) for p, _ in items]) - self.chars[node], sum([n for _, n in items]) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, at: int, deleted: int, inserted: str) -> int:
        """Replace so many characters at a place; both are cut to the text. Returns the characters that were encoded again."""
        at = min(max(at, 0), self.n_chars)
        deleted = min(max(deleted, 0), self.n_chars - at)
        if not deleted and not inserted:
            return 0
        # From the first pre-token that the edit can reach: the one that holds the place so many characters before.
        leaf, start, _ = self._find(max(0, at - AHEAD))
        first, inside = leaf, 0
        items = self.leaf(leaf)
        while inside < len(items) and start + len(items[inside][0]) + AHEAD <= at:
            start += len(items[inside][0])
            inside += 1
        before = items[:inside]
        # The old pre-tokens from there on, taken leaf by leaf until new and old boundaries meet behind the edit.
        old = items[inside:]
        held = "".join(p for p, _ in old)
        while True:
            more = leaf + 1 < len(self.leaves)
            if start + len(held) < at + deleted and more:
                leaf += 1
                old = old + self.leaf(leaf)
                held = "".join(p for p, _ in old)
                continue
            new_text = held[: at - start] + inserted + held[at - start + deleted :]
            change = len(inserted) - deleted
            ends = set(np.cumsum([len(p) for p, _ in old]).tolist())
            pieces, place, meets = [], 0, None
            for m in self.counter.pattern.finditer(new_text):
                pieces.append(m[0])
                place = m.end()
                if place >= at - start + len(inserted) and place - change in ends and (place + AHEAD <= len(new_text) or not more):
                    meets = place - change
                    break
            if meets is not None or not more:
                break
            leaf += 1
            old = old + self.leaf(leaf)
            held = "".join(p for p, _ in old)
        rest, passed = [], 0
        if meets is not None:
            for p, n in old:
                if passed >= meets:
                    rest.append((p, n))
                passed += len(p)
        items = before + list(zip(pieces, self.counter.counts(pieces), strict=True)) + rest
        if len(items) <= 2 * LEAF * (leaf - first + 1):
            share = -(-len(items) // (leaf - first + 1))
            for k in range(first, leaf + 1):
                self._set(k, items[(k - first) * share : (k - first + 1) * share])
        else:  # too many for these leaves
            every = [x for k in range(first) for x in self.leaf(k)] + items + [x for k in range(leaf + 1, len(self.leaves)) for x in self.leaf(k)]
            self._build([p for p, _ in every], [n for _, n in every])
        return sum(map(len, pieces))


def edited_counts(docs: DataFrame, edits: str | Column, text: str = "text", id: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens (before), n_tokens_edited, n_chars_edited, n_edits, n_reencoded (characters), edited_sha256.

    edits: a column of docs, array<struct<at:int,deleted:int,inserted:string>>, applied in turn: at and deleted count characters
    of the text as the edits before left it, and are cut to it. Null texts are empty, null edits are none, nulls in an edit are
    0 or empty. Ids may be null or repeat: rows are counted each. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    column = F.col(edits) if isinstance(edits, str) else edits
    kind = "array<struct<at:int,deleted:int,inserted:string>>"
    names = ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_edits", "n_reencoded", "edited_text"]
    types = [pa.int64()] * 6 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                out = []
                ids, texts, edits_of = (c.to_pylist() for c in part.columns)
                pieces = list(map(count.pieces, texts))
                count.learn(set().union(*pieces))  # of many documents at once
                for doc, whole, changes, own in zip(ids, texts, edits_of, pieces, strict=True):
                    tree, again = SegmentTree(whole, count, own), 0
                    before = tree.n_tokens
                    for e in changes or ():
                        if e is not None:
                            again += tree.edit(e["at"] or 0, e["deleted"] or 0, e["inserted"] or "")
                    out.append((doc, before, tree.n_tokens, tree.n_chars, len(changes or ()), again, tree.text()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), whole_text(text).alias("text"), column.cast(kind).alias("edits"))
    out = rows.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_edits long, n_reencoded long, edited_text string")
    return out.withColumn("edited_sha256", F.sha2(F.col("edited_text").cast("binary"), 256))


def sample_edits(text: str = "text", id: str = "doc_id") -> Column:
    """Three edits that depend on the document alone: a word replaced a third in, a span taken out of the middle, and a line put in three quarters in."""
    n, k = F.length(whole_text(text)), F.pmod(F.xxhash64(F.col(id)), F.lit(7)).cast("int")

    def edit(at, deleted, inserted):
        return F.struct(at.cast("int").alias("at"), deleted.cast("int").alias("deleted"), inserted.alias("inserted"))

    return F.array(
        edit(n / 3 + k, F.lit(5), F.lit("it's edited")),
        edit(n / 2, k * 3, F.lit("")),
        edit(3 * n / 4, F.lit(0), F.concat(F.lit("\n  put in "), F.col(id).cast("string"), F.lit(" here\n"))),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return edited_counts(docs, sample_edits()).drop("edited_text")
