"""Language-model scoring with a probabilistic suffix tree over words.

A context is retained if its suffix is, and if the distribution of what follows it diverges from its suffix's by more than the
probabilities that it adds are worth: if its gain in log likelihood is over half the logarithm of all tokens for each of them.
Contexts grow by one word a round, from the strings that the tree has, for as long as a round retains any. Each token
is scored in the longest retained suffix of what precedes it; distributions are smoothed by absolute discounting into the
suffix's, down to the add-one unigram distribution.

Strings of words are known by 64-bit hashes, and counts, contexts and probabilities are tables: nothing that grows with the corpus
is collected. A text's score is a sum over its strings, so that scoring is one join: a retained context of weight w adds log w to
each string that ends with it, and a string with a probability of its own adds what that is beyond the backed-off one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import documents, small_batches, whole_text, written
from skein.llm.keyfilter import KeyBits, packed_key_bits
from skein.session import drop_table, free_shuffles

#: What absolute discounting takes from each count.
DISCOUNT = 0.75
#: Counts from which a string is part of the model: what is seen once tells nothing beyond its suffix.
LEAST_COUNT = 2
#: Strings that are at least this part of all training tokens are broadcast, 1 / HOT_SHARE of each length at most; a join finds all
#: others. It decides where a string is looked up, not whether.
HOT_SHARE = 5e-7
#: Strings that a worker gathers before it counts them.
STRINGS = 1_000_000
#: Bytes of texts, and texts at most, that are hashed at once: what is computed of them stays within a core's cache.
PART_BYTES, PART_TEXTS = 192 << 10, 512
#: Buckets in which strings of texts meet, at least.
LEAST_BUCKETS = 48
#: Lengths that are counted at once at most, and the part of all tokens that their strings are together at most.
AHEAD, AHEAD_SHARE = 8, 0.5
#: Bytes of a word from which on it is hashed by itself.
LONG_WORD = 64
#: The hash of the end of a text: that of the empty word.
END = xxhash.xxh64_intdigest(b"")
#: Bytes in lower case (A-Z), those that are part of words, and what is kept of eight bytes of which the first k are a word's.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
IN_WORD = ~np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
KEPT_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: The primes of XXH64.
PRIMES = tuple(np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def is_training(id: Column) -> Column:
    """Whether the crc32 of the id as text, modulo 7, isn't 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def hashed_pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """What the SQL function xxhash64 gives for two longs."""
    p1, p2, p3, p4, p5 = PRIMES
    found = np.full(len(one), 42, np.uint64)
    for x in (one, two):
        found = found + p5 + np.uint64(8) ^ _turned(x.view(np.uint64) * p2, 31) * p1
        found = _turned(found, 27) * p1 + p4
        found = (found ^ found >> np.uint64(33)) * p2
        found = (found ^ found >> np.uint64(29)) * p3
        found ^= found >> np.uint64(32)
    return found.view(np.int64)


def string_keys(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Keys from those of two strings, or of two longs, in a third of the steps of xxhash64. Equal contexts (or suffixes) and different suffixes (contexts) have different keys."""
    p1, p2, p3 = PRIMES[:3]
    found = context.view(np.uint64) * p1
    found ^= found >> np.uint64(32)
    found += suffix.view(np.uint64)
    found *= p2
    found ^= found >> np.uint64(29)
    found *= p3
    found ^= found >> np.uint64(32)
    return found.view(np.int64)


class KeyTable:
    """Keys that are hashes, sorted, with where those of each start of their bits begin: a key is found in a few steps for all at once."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys.view(np.uint64))
        self.keys = keys[self.order]
        bits = max(1, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys.view(np.uint64) >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys asked for are there, and at which place of the sorted keys."""
        part = (asked.view(np.uint64) >> self.shift).astype(np.int64)
        at, end = self.starts[part], self.starts[part + 1]
        which, found = np.flatnonzero(at < end), np.zeros(len(asked), bool)
        while len(which):
            same = self.keys[at[which]] == asked[which]
            found[which[same]] = True
            which = which[~same]
            at[which] += 1
            which = which[at[which] < end[which]]
        return np.flatnonzero(found), at[found]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of the words of some bytes (uint8, eight more at the end), eight bytes at a time; long ones by XXH64."""
    blocks = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = ends - starts
    out = string_keys(size, (blocks[starts] & KEPT_BYTES[np.minimum(size, 8)]).view(np.int64))
    left, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(left):
        part = blocks[starts[left] + done] & KEPT_BYTES[np.minimum(size[left] - done, 8)]
        out[left] = string_keys(out[left], part.view(np.int64))
        done += 8
        left = left[size[left] > done]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = np.uint64(xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())).view(np.int64)
    return out


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of texts (binary, no nulls), which are the hashes of the words, in lower case, and of the end; which text each is of, and its
    place there."""
    texts = texts.to_pylist()
    data = np.frombuffer(b" ".join([*(t for t in texts), b" " * 8]), np.uint8)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    data = LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    np.take(IN_WORD, data, out=inside[1:])  # the first is before the text, and the last is a space
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    before = np.searchsorted(starts, bounds)  # the words up to each text's end
    n, sizes = len(texts), np.diff(before, prepend=0) + 1
    last = np.cumsum(sizes)
    out, is_end = np.empty(len(starts) + n, np.int64), np.zeros(len(starts) + n, bool)
    is_end[last - 1] = True
    out[is_end] = np.uint64(END).view(np.int64)
    out[~is_end] = word_hashes(data, starts, ends)
    return out, np.repeat(np.arange(n), sizes), np.arange(len(out)) - np.repeat(last - sizes, sizes)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where parts of texts (binary) begin, and how many texts each has: about PART_BYTES, or a longer text."""
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // PART_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in pairwise([*starts.tolist(), len(part)]):
        yield from ((k, min(PART_TEXTS, b - k)) for k in range(a, b, PART_TEXTS))


def _longer(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the keys of the strings that end at each place: the string's context, which ends one place before, and the key of both."""
    context = np.concatenate((key[:1], key[:-1]))
    return context, string_keys(context, key)


def _laid_out(n: int, columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c, f.type)) if (c := columns.get(f.name)) is not None else pa.nulls(n, f.type) for f in schema], schema=schema)


def _in_buckets(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by buckets (within one as given), the buckets that have any, and where each begins and the last ends."""
    bucket = ((key >> 20) % buckets).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    some, starts = np.unique(bucket[order], return_index=True)
    return order, some.astype(np.int32), np.append(starts, len(key))


def _cut(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Rows of an array as bytes, from each start to the next."""
    size = data.nbytes // max(len(data), 1)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * size).astype(np.int32)), pa.py_buffer(data.tobytes())])


#: Strings of one length, packed by buckets of their keys: how many there are, how often they occur together, and for each its key, n (int64),
#: probability and what it adds to a score (float64). Kinds: strings on their way to what they ask for (key is what decides on their bucket, other the
#: other one of suffix and context, p the probability after the suffix), strings of the tree, others, contexts, and words seen less than LEAST_COUNT times.
TREE = "kind int, length int, bucket int, many long, seen long, key binary, other binary, n binary, p binary, value binary"
_TREE = pa.schema([*((c, pa.int32()) for c in ("kind", "length", "bucket")), ("many", pa.int64()), ("seen", pa.int64()), *((c, pa.binary()) for c in ("key", "other", "n", "p", "value"))])
ASKING, IN_TREE, OUTSIDE, CONTEXT, RARE = range(5)


def _level(kind: int, length: int, buckets: int, key: np.ndarray, n: np.ndarray, **more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of TREE."""
    if len(key):
        order, some, starts = _in_buckets(key, buckets)
        n = n[order].astype(np.int64)
        fixed = {"kind": np.full(len(some), kind, np.int32), "length": np.full(len(some), length, np.int32), "bucket": some, "many": np.diff(starts), "seen": np.add.reduceat(n, starts[:-1])}
        yield _laid_out(len(some), {**fixed, "key": _cut(key[order], starts), "n": _cut(n, starts), **{c: _cut(x[order], starts) for c, x in more.items()}}, _TREE)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != held[0]["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _column(rows: list[dict], name: str, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


#: Strings that texts have, packed by buckets: contexts, suffixes and how often (int32), and by how much each is longer than the shortest (uint8).
COUNTED = "bucket int, ctx binary, suf binary, n binary, longer binary"
_COUNTED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("ctx", "suf", "n", "longer"))])


def _of_texts(held: list[list[tuple[np.ndarray, ...]]], buckets: int) -> pa.RecordBatch:
    """held: for each length the keys of strings, their contexts and suffixes. Rows of COUNTED, equal strings summed."""
    longer = np.repeat(np.arange(len(held), dtype=np.uint8), [sum(len(h[0]) for h in rows) for rows in held])
    key, ctx, suf = (np.concatenate([h[j] for rows in held for h in rows]) for j in range(3))
    bucket = (key >> 20) % buckets  # fewer than 1 << 16
    # Within a bucket by contexts, whose repetitions compress, and by strings there; one that this splits is summed later.
    order = np.argsort(bucket << 47 | (ctx >> 40 & (1 << 24) - 1) << 23 | key >> 41 & (1 << 23) - 1)
    starts = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] - 1))
    first, n = order[starts], np.diff(starts, append=len(key))
    bucket = bucket[first]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(at, len(first))
    return _laid_out(len(at), {"bucket": bucket[at].astype(np.int32), "ctx": _cut(ctx[first], ends), "suf": _cut(suf[first], ends), "n": _cut(n.astype(np.int32), ends), "longer": _cut(longer[first], ends)}, _COUNTED)


def _sums(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of rows of COUNTED, a bucket's together, by how much they are longer, contexts, suffixes and numbers of the strings that occur at least so often.
    Holds the distinct strings of a bucket."""
    kinds = {"longer": np.uint8, "ctx": np.int64, "suf": np.int64, "n": np.int32}

    def summed(waiting: list[list[np.ndarray]]) -> list[np.ndarray]:
        longer, ctx, suf, n = (np.concatenate([w[j] for w in waiting]) for j in range(4))
        mixed = (ctx.view(np.uint64) * PRIMES[0] + suf.view(np.uint64)).view(np.int64)
        order = np.argsort(mixed)
        starts = np.flatnonzero(np.diff(mixed[order], prepend=mixed[order[:1]] - 1))
        first = order[starts]
        return [longer[first], ctx[first], suf[first], np.add.reduceat(n[order], starts, dtype=np.int64)]

    now, waiting, size, distinct = None, [], 0, 0
    for row in (r for batch in batches for r in batch.to_pylist()):
        if row["bucket"] != now and waiting:
            found = summed(waiting)
            some = found[3] >= least
            yield tuple(x[some] for x in found)
            waiting, size, distinct = [], 0, 0
        now = row["bucket"]
        waiting.append([np.frombuffer(row[c], kind) for c, kind in kinds.items()])
        size += len(waiting[-1][0])
        if size > max(STRINGS, 2 * distinct):
            waiting = [summed(waiting)]
            size = distinct = len(waiting[0][0])
    if waiting:
        found = summed(waiting)
        some = found[3] >= least
        yield tuple(x[some] for x in found)


def _counted(batches: Iterator[pa.RecordBatch], length: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTED to len, ctx, suf, n."""
    for longer, *columns in _sums(batches, least):
        yield pa.RecordBatch.from_arrays([pa.array(longer.astype(np.int32) + np.int32(length)), *map(pa.array, columns)], names=["len", "ctx", "suf", "n"])


def _counted_level(batches: Iterator[pa.RecordBatch], length: int, least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTED to those of TREE, which ask for their suffix."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        longer, ctx, suf, n = (np.concatenate([h[j] for h in held]) for j in range(4))
        for k in np.flatnonzero(np.bincount(longer)).tolist():
            some = np.flatnonzero(longer == k)
            yield from _level(ASKING, length + k, buckets, suf[some], n[some], other=ctx[some])

    for found in _sums(batches, least):
        held.append(found)
        size += len(found[0])
        if size > STRINGS:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def string_counts(texts: DataFrame, length: int, contexts: KeyBits | None, suffixes: KeyBits | None, more: int = 0, least: int = 1, buckets: int | None = None, packed: bool = False) -> DataFrame:
    """len, ctx, suf, n (packed: rows of TREE) of the training strings of a length: their context, which ends one symbol before them, and their suffix, which
    lacks the first one. contexts, suffixes: which are asked for (None: all); rows of others may come too. Words (length 1) have 0 for ctx. texts: training, text (binary).

    more: so many lengths beyond it are counted, too, of strings all of whose parts of that length are asked for.
    least: how often a string must occur. buckets: in how many parts strings meet, each of which is held at once; twice the shuffle partitions if None.
    Texts are read and hashed anew each time: a table of the hashes would take more disk than the texts do."""
    spark = texts.sparkSession
    buckets = buckets or min(1 << 16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    held_filters = spark.sparkContext.broadcast((contexts, suffixes))  # two bitmaps, each of at most keyfilter.FILTER_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (before, behind), held, size = held_filters.value, [[] for _ in range(more + 1)], 0
        for batch in batches:
            for part in (batch.column(0).slice(*x) for x in _parts(batch.column(0))):
                key, _, place = symbols(part)
                ctx, suf = np.zeros(len(key), np.int64), key
                for _ in range(length - 1):
                    suf = key
                    ctx, key = _longer(key)
                some = np.flatnonzero(place >= length - 1)
                if behind is not None:
                    some = some[behind.may_have(suf[some])]
                if before is not None:
                    some = some[before.may_have(ctx[some])]
                for k in range(more + 1):
                    if k:  # both parts that are shorter by one are asked for
                        asked = np.zeros(len(key), bool)
                        asked[some] = True
                        some = some[(place[some] >= length - 1 + k) & asked[some - 1]]
                        suf = key
                        ctx, key = _longer(key)
                    if not len(some):
                        break
                    held[k].append((key[some], ctx[some], suf[some]))
                    size += len(some)
                if size > STRINGS:
                    yield _of_texts(held, buckets)
                    held, size = [[] for _ in range(more + 1)], 0
        if size:
            yield _of_texts(held, buckets)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted_level(batches, length, least, buckets) if packed else _counted(batches, length, least)

    # Equal strings meet in buckets, many strings a row: as rows of their own they would cost more than their counting.
    found = texts.filter("training").select("text").mapInArrow(run, COUNTED)
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(counted, TREE if packed else "len int, ctx long, suf long, n long")


def _with_below(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of TREE, a bucket's together: strings and the tree's of their suffixes. Those whose suffix is there, with its probability; they ask for their context."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        ctx, suf, n, below = (np.concatenate([h[j] for h in held]) for j in range(4))
        return _level(ASKING, length, buckets, ctx, n, other=suf, p=below)

    for rows in _by_bucket(batches):
        asking, there = ([r for r in rows if r["kind"] == kind] for kind in (ASKING, IN_TREE))
        if asking and there:
            table = KeyTable(_column(there, "key"))
            suf, ctx, n = (_column(asking, c) for c in ("key", "other", "n"))
            which, at = table.find(suf)
            held.append((ctx[which], suf[which], n[which], _column(there, "p", np.float64)[table.order[at]]))
            size += len(which)
            if size > STRINGS:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def _grown(batches: Iterator[pa.RecordBatch], length: int, price: float, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of TREE, a bucket's together: strings with the probability after their suffix, and those shorter by one, of which their contexts are. The strings whose
    context is there, and the contexts that are retained: whose gain in log likelihood exceeds the price of their probabilities. Holds a bucket's strings."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, n, p, value, ins, contexts, totals, backed = (np.concatenate([h[j] for h in held]) for j in range(8))
        yield from _level(IN_TREE, length, buckets, key[ins], n[ins], p=p[ins], value=value[ins])
        yield from _level(OUTSIDE, length, buckets, key[~ins], n[~ins])
        yield from _level(CONTEXT, length, buckets, contexts, totals, value=backed)

    for rows in _by_bucket(batches):
        asking, there = [r for r in rows if r["kind"] == ASKING], [r for r in rows if r["kind"] != ASKING]
        if not asking or not there:
            continue
        table = KeyTable(_column(there, "key"))
        ctx, suf, n, below = (_column(asking, c, kind) for c, kind in (("key", np.int64), ("other", np.int64), ("n", np.int64), ("p", np.float64)))
        which, at = table.find(ctx)
        if not len(which):
            continue
        order = np.argsort(ctx[which])
        which, total = which[order], _column(there, "n")[table.order[at[order]]]
        ctx, suf, n, below = ctx[which], suf[which], n[which], below[which]
        starts = np.flatnonzero(np.diff(ctx, prepend=ctx[:1] - 1))
        many = np.diff(starts, append=len(ctx))
        share = (n - DISCOUNT) / total
        weight, totals = 1 - np.add.reduceat(share, starts), total[starts]  # the weight is what backs off
        own = share + np.repeat(weight, many) * below
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = np.add.reduceat(n * np.log(own / below), starts) + np.maximum(totals - np.add.reduceat(n, starts), 0) * np.log(weight)
        good = gain > price * (many + 1)
        ins = np.repeat(good, many)
        value = np.zeros(len(ctx))
        value[ins] = np.log10(own[ins] / (below * np.repeat(weight, many))[ins])
        held.append((string_keys(ctx, suf), n, np.where(ins, own, below), value, ins, ctx[starts][good], totals[good], np.log10(weight[good])))
        size += len(ctx)
        if size > STRINGS:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _of_kind(level: DataFrame, kinds: list[int], *columns: str) -> DataFrame:
    """Rows of TREE of some kinds, with some of the columns that not all need."""
    return level.filter(F.col("kind").isin(kinds)).select(*[c if c in (*columns, "kind", "length", "bucket", "many", "seen", "key") else F.lit(None).cast("binary").alias(c) for c in _TREE.names])


def _met(one: DataFrame, two: DataFrame, run) -> DataFrame:
    """Two tables' buckets meet, many strings a row: strings of one key may be in many texts, but each comes once."""
    return one.unionByName(two).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, TREE)


def first_level(words: DataFrame, tokens: int, distinct: int, buckets: int) -> DataFrame:
    """The words (key, n) as rows of TREE. What a word adds to a score is log10(n + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = (np.concatenate([h[j] for h in held]) for j in range(2))
            ins, one = n >= LEAST_COUNT, n + 1.0
            yield from _level(IN_TREE, 1, buckets, key[ins], n[ins], p=one[ins] / (tokens + distinct + 1), value=np.log10(one[ins]))
            yield from _level(RARE, 1, buckets, key[~ins], n[~ins], value=np.log10(one[~ins]))

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(2)])
            size += batch.num_rows
            if size > STRINGS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return words.select("key", "n").mapInArrow(run, TREE)


def train(texts: DataFrame, tokens: int, distinct: int, words: DataFrame, buckets: int, deepest: int | None = None) -> list[DataFrame]:
    """The model: for each length of strings rows of TREE, of which those of the tree and contexts have a value, what a string adds to the score of
    a text for each time that it occurs there. words: key, n."""
    spark, price = texts.sparkSession, 0.5 * float(np.log(max(tokens, 2)))
    levels, length = [written(first_level(words, tokens, distinct, buckets), "tree-1")], 1
    drop_table(words)
    counts, counted = None, 1
    while deepest is None or length <= deepest:
        shorter = levels[-1]
        if counted == length:
            if counts is not None:
                drop_table(counts)
            # A place counts for a longer string only if it does for this one: where few do, the lengths that follow are counted at once.
            places = shorter.filter(F.col("kind") == IN_TREE).agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
            more = int(min(AHEAD, max(1, AHEAD_SHARE * tokens // max(places, 1)))) - 1
            before, behind = (packed_key_bits(shorter.filter(F.col("kind").isin(kinds)), "key", "many") for kinds in ([IN_TREE, OUTSIDE], [IN_TREE]))
            counts = string_counts(texts, length + 1, before, behind, more, LEAST_COUNT, buckets, packed=True)
            counts, counted = written(counts, f"counts-{length + 1}"), length + 1 + more
            free_shuffles(spark)

        def with_below(batches: Iterator[pa.RecordBatch], length: int = length + 1) -> Iterator[pa.RecordBatch]:
            return _with_below(batches, length, buckets)

        def grown(batches: Iterator[pa.RecordBatch], length: int = length + 1) -> Iterator[pa.RecordBatch]:
            return _grown(batches, length, price, buckets)

        below = _met(counts.filter(F.col("length") == length + 1), _of_kind(shorter, [IN_TREE], "p"), with_below)
        level = written(_met(below, _of_kind(shorter, [IN_TREE, OUTSIDE], "n"), grown), f"tree-{length + 1}")
        if counted == length + 1:
            drop_table(counts)
            counts = None
        free_shuffles(spark)
        if level.filter(F.col("kind") == CONTEXT).isEmpty():
            drop_table(level)
            break
        levels.append(level)
        length += 1
    if counts is not None:
        drop_table(counts)
    return levels


#: Columns of strings that meet in buckets: of the model keys and weights (known, base, value); of texts the keys asked for, the number of
#: the first text, and owners, the steps from one key's text to the next one's; or a text's own sums.
PACKED = "bucket int, keys binary, weights binary, owners binary, row long, doc_id long, training boolean, tokens long, known double, base double, value double"
_PACKED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "weights", "owners")), ("row", pa.int64()), ("doc_id", pa.int64()), ("training", pa.bool_()), ("tokens", pa.int64()), *((c, pa.float64()) for c in ("known", "base", "value"))])
#: A text's sums, or parts of them.
PARTIAL = "row long, doc_id long, training boolean, tokens long, known double, base double, value double"
_PARTIAL = pa.schema([_PACKED.field(c.split()[0]) for c in PARTIAL.split(", ")])


def _asked(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """held: keys, and the number of each one's text, which don't fall."""
    key, row = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    order, some, starts = _in_buckets(key, buckets)
    row = row[order]
    steps = np.diff(row, prepend=row[:1])
    steps[starts[:-1]] = 0
    steps = steps.astype(np.uint16 if steps.max(initial=0) < 1 << 16 else np.int64)
    yield _laid_out(len(some), {"bucket": some, "keys": _cut(key[order], starts), "owners": _cut(steps, starts), "row": row[starts[:-1]]}, _PACKED)


def _of_model(held: list[list[np.ndarray]], buckets: int) -> pa.RecordBatch:
    key, *weights = (np.concatenate([h[k] for h in held]) for k in range(4))
    order, some, starts = _in_buckets(key, buckets)
    return _laid_out(len(some), {"bucket": some, "keys": _cut(key[order], starts), "weights": _cut(np.stack(weights, axis=1).astype(np.float64)[order], starts)}, _PACKED)


def _weights(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of TREE keys, how often each occurs, and weights: known (1 for a word), base (log10(n + 1) for a word, else 0), value."""
    value = np.frombuffer(row["value"], np.float64)
    word = np.full(len(value), float(row["length"] == 1 and row["kind"] != CONTEXT))
    return np.frombuffer(row["key"], np.int64), np.frombuffer(row["n"], np.int64), np.stack([word, word * value, value], axis=1)


def _each_once(key: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A string may be of the tree and a context: its weights are summed."""
    order = np.argsort(key)
    starts = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] - 1))
    return key[order[starts]], (np.add.reduceat(weights[order], starts) if len(key) else weights)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED, a bucket's model first, to those of PARTIAL: the sums of the keys asked for that the model has, by text, as far as gathered."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    asked: list[tuple[np.ndarray, np.ndarray]] = []
    model: list[tuple[bytes, bytes]] = []
    bucket, size, waiting = None, 0, 0

    def summed() -> None:
        """The rows gathered, each text once."""
        nonlocal size
        row, of = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        sums = np.concatenate([f[1] for f in found])
        found[:] = [(row, np.stack([np.bincount(of, sums[:, k], len(row)) for k in range(3)], axis=1))]
        size = len(row)

    def look_up() -> None:
        nonlocal size, waiting
        if asked and model:
            key, row = (np.concatenate([a[k] for a in asked]) for k in (0, 1))
            keys, weights = _each_once(np.frombuffer(b"".join(m[0] for m in model), np.int64), np.frombuffer(b"".join(m[1] for m in model), np.float64).reshape(-1, 3))
            table = KeyTable(keys)
            which, at = table.find(key)
            found.append((row[which], weights[table.order[at]]))
            size += len(which)
        asked.clear()
        waiting = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        for row, sums in found:
            yield _laid_out(len(row), {"row": row, "known": sums[:, 0], "base": sums[:, 1], "value": sums[:, 2]}, _PARTIAL)
        found.clear()
        size = 0

    for batch in batches:
        own = batch.filter(batch.column(7).is_valid())
        if own.num_rows:
            yield own.select(_PARTIAL.names)
        for part in batch.filter(batch.column(1).is_valid()).select(["bucket", "keys", "weights", "owners", "row"]).to_pylist():
            if part["bucket"] != bucket:
                look_up()
                model.clear()
                bucket = part["bucket"]
            if part["weights"] is not None:
                model.append((part["keys"], part["weights"]))
                continue
            key = np.frombuffer(part["keys"], np.int64)
            steps = np.frombuffer(part["owners"], np.uint16 if len(part["owners"]) == 2 * len(key) else np.int64)
            asked.append((key, part["row"] + np.cumsum(steps, dtype=np.int64)))
            waiting += len(key)
            if waiting > STRINGS:
                look_up()
            if size > STRINGS:
                summed()
                if size > STRINGS // 2:
                    yield from flush()
    look_up()
    if found:
        summed()
    yield from flush()


#: Texts' own sums, one a row, and packed ones of many texts: which part of the texts they are of, their numbers and sums.
RETURNED = PARTIAL + ", part int, rows binary, knowns binary, bases binary, values binary"
_RETURNED = pa.schema([*_PARTIAL, ("part", pa.int32()), *((c, pa.binary()) for c in ("rows", "knowns", "bases", "values"))])
#: What is known of a text in the end.
SUMMED = "doc_id long, training boolean, tokens long, known double, base double, value double"
_SUMMED = pa.schema([_PARTIAL.field(c.split()[0]) for c in SUMMED.split(", ")])


def _returned(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of PARTIAL to those of RETURNED: parts of texts' sums, of which each bucket has some for nearly all texts, are packed."""
    for batch in batches:
        row = batch.column(0).to_numpy()
        part = (row % parts).astype(np.int32)
        if not batch.column(3).null_count:  # texts' own
            yield _laid_out(len(row), {"part": part, **{f.name: batch.column(k) for k, f in enumerate(_PARTIAL)}}, _RETURNED)
            continue
        order = np.argsort(part, kind="stable")
        some, starts = np.unique(part[order], return_index=True)
        columns = [row, *(batch.column(k).to_numpy() for k in (4, 5, 6))]
        cut = {c: _cut(x[order], np.append(starts, len(row))) for c, x in zip(("rows", "knowns", "bases", "values"), columns, strict=True)}
        yield _laid_out(len(some), {"part": some, **cut}, _RETURNED)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RETURNED, sorted by part, to those of SUMMED: a row for each text. Holds the texts of a part."""
    own: list[pa.RecordBatch] = []
    waiting: list[dict] = []
    now = None

    def flush() -> pa.RecordBatch:
        texts = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
        number = texts.column(0).to_numpy()
        order = np.argsort(number)
        sums = np.stack([texts.column(k).to_numpy() for k in (4, 5, 6)])
        for packed in waiting:
            at = order[np.searchsorted(number, np.frombuffer(packed["rows"], np.int64), sorter=order)]
            for k, c in enumerate(("knowns", "bases", "values")):
                sums[k] += np.bincount(at, np.frombuffer(packed[c], np.float64), len(number))
        own.clear()
        waiting.clear()
        return _laid_out(len(number), {"doc_id": texts.column(1), "training": texts.column(2), "tokens": texts.column(3), "known": sums[0], "base": sums[1], "value": sums[2]}, _SUMMED)

    for batch in batches:
        part = batch.column(7).to_numpy()
        starts = np.flatnonzero(np.diff(part, prepend=part[:1] - 1))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(part)).tolist(), strict=True):
            if part[a] != now and own:
                yield flush()
            now = part[a]
            some = batch.slice(a, b - a)
            texts = some.filter(some.column(3).is_valid())
            own += [texts] * bool(texts.num_rows)
            waiting += some.filter(some.column(8).is_valid()).select(["rows", "knowns", "bases", "values"]).to_pylist()
    if own:
        yield flush()


def score(docs: DataFrame, text: str = "text", id: str = "doc_id", training: Column | None = None, deepest: int | None = None, hot_share: float = HOT_SHARE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, A-Z in lower case, and one end. base_score sums log10((c+1)/(N+V+1)) over the tokens, with c a token's
    count, N all and V distinct training tokens; score is the tree's log10 probability of the same tokens. n_known: tokens with
    c > 0. Null texts are an end alone. Ids may be null or repeat: rows are scored each. Without training rows N is 0 and
    every token has the probability of an unknown one. Other columns are ignored; an empty table gives no rows.
    docs is read once for each length of strings, and must give the same rows each time.
    deepest: the words of a context at most; None grows contexts for as long as any is retained.
    """
    spark = docs.sparkSession
    small_batches(spark)
    training = is_training(F.col(id)) if training is None else training
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(training, F.lit(True)).alias("training"), whole_text(text).cast("binary").alias("text"))
    words = written(string_counts(texts, 1, None, None).select(F.col("suf").alias("key"), "n"), "words")
    tokens, distinct = (int(x) for x in words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first())
    free_shuffles(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, parts = min(1 << 16, max(LEAST_BUCKETS, 4 * tokens // STRINGS + 1)), 2 * partitions
    levels = train(texts, tokens, distinct, words, buckets, deepest)
    longest, model = len(levels), None
    for level in levels:
        some = _of_kind(level, [IN_TREE, CONTEXT, RARE], "n", "value")
        model = some if model is None else model.unionByName(some)
    free_shuffles(spark)
    hot = hot_share * tokens

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, weights in (_weights(row) for batch in batches for row in batch.to_pylist()):
            some = n >= hot
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[some]), *(pa.array(weights[some, k]) for k in range(3))], names=["key", "known", "base", "value"])

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for row in batch.to_pylist():
                key, n, weights = _weights(row)
                some = n < hot
                if some.any():
                    held.append({"bucket": row["bucket"], "keys": key[some].tobytes(), "weights": weights[some].tobytes()})
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_PACKED)

    found = model.mapInArrow(head, "key long, known double, base double, value double").toArrow()  # 2 / hot_share rows of each length at most
    keys, weights = _each_once(found.column(0).to_numpy(), np.stack([found.column(k).to_numpy() for k in range(1, 4)], axis=1))
    table = KeyTable(keys)
    given = spark.sparkContext.broadcast((table, list(np.ascontiguousarray(weights[table.order].T)), packed_key_bits(model, "key", "many"), packed_key_bits(model.filter(F.col("kind") == CONTEXT), "key", "many")))
    unit = float(np.log10(tokens + distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, columns, everything, contexts), held, size = given.value, [], 0
        for batch in batches:
            for part in (batch.slice(*x) for x in _parts(batch.column(3))):
                key, owner, place = symbols(part.column(3))
                n, sums, row, rest = part.num_rows, np.zeros((3, part.num_rows)), [], []
                at = np.arange(len(key))  # the ends of strings that may have a value
                for length in range(1, longest + 1):
                    found = at if everything is None else at[everything.may_have(key[at])]
                    hit, which = table.find(key[found])
                    of = owner[found[hit]]
                    for k, column in enumerate(columns):
                        if k == 2 or length == 1:  # only words are known or have a base
                            sums[k] += np.bincount(of, column[which], n)
                    found = np.delete(found, hit)
                    row.append(owner[found])
                    rest.append(key[found])
                    # A longer string has a value only if its context is retained, or itself: then its suffix is, too.
                    may = np.ones(len(key), bool) if contexts is None else contexts.may_have(key)
                    may[1:] |= may[:-1]
                    at = np.flatnonzero(may & (place >= length))
                    if not len(at):
                        break
                    key = _longer(key)[1]
                ids, of = part.column(0).to_numpy(), np.concatenate(row)
                order = np.argsort(of.astype(np.uint16), kind="stable")
                held.append((np.concatenate(rest)[order], ids[of[order]]))
                size += len(of)
                # A text's own sums go to any bucket.
                yield _laid_out(n, {"bucket": (ids % buckets).astype(np.int32), "row": ids, "doc_id": part.column(1), "training": part.column(2), "tokens": np.bincount(owner, minlength=n), "known": sums[0], "base": sums[1], "value": sums[2]}, _PACKED)
                if size > STRINGS:
                    yield from _asked(held, buckets)
                    held, size = [], 0
        if size:
            yield from _asked(held, buckets)

    def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _returned(_joined(batches), parts)

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "training", "text")
    # The few strings that are left of a text come by a join, in which buckets of strings meet, many strings a row.
    both = numbered.mapInArrow(run, PACKED).unionByName(model.mapInArrow(cold, PACKED))
    joined = both.repartition("bucket").sortWithinPartitions("bucket", F.col("weights").isNull()).mapInArrow(returned, RETURNED)
    summed = joined.repartition("part").sortWithinPartitions("part").mapInArrow(_summed, SUMMED)
    return summed.select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        F.round("known").cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("tokens") * unit).alias("base_score"),
        (F.col("value") - F.col("tokens") * unit).alias("score"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
