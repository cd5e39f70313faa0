"""Packing by power-of-two decomposition: each document is cut into pieces of binary length, and equal lengths form a bucket."""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import compress
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import documents, release, remembered, small_batches, whole_text

#: Fixed values of the packing contract: the longest sequence, and the id that ends a document.
LONGEST, END_ID = 4096, 2
#: Bytes that a Python worker's remembered words take before it starts afresh: of words that were in one call's texts only, and of
#: those that were in others', too. OVERHEAD: of a word, besides its characters and ids. Both bound its memory, and no result.
ONCE, AGAIN, OVERHEAD = 24 << 20, 48 << 20, 200
#: Bytes of texts that are encoded together at most, but for one text that has more.
TOGETHER = 2 << 20
#: Fixed value: marks that may follow a word of letters.
MARKS = string.punctuation.encode()
#: Words of Latin letters (without İ, whose lower case is two characters), and the rules under which they need no more than lower case.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
is_none = partial(is_, None)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Words to their ids, within so many bytes: what is remembered beyond them starts afresh."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.bytes = most, 0

    def remember(self, found: dict[bytes, bytes]) -> None:
        size = self.size(found)
        if self.bytes + size > self.most:
            self.clear()
            self.bytes = 0
        if size <= self.most:
            self.update(found)
            self.bytes += size

    def forget(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Those of the words that are remembered, which aren't any more then."""
        found = {w: self.pop(w) for w in words if w in self}
        self.bytes -= self.size(found)
        return found

    @staticmethod
    def size(found: dict[bytes, bytes]) -> int:
        return OVERHEAD * len(found) + sum(map(len, found)) + sum(map(len, found.values()))


def letters_tokenizer(path: str):
    """The same model for words of Latin letters, without what these don't need (regular expressions, composing), and which of its
    ids end a word. None if the file's rules aren't those it is known to agree with."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    model = rules["model"]
    suffix = model.get("end_of_word_suffix")
    if {k: rules[k] for k in RULES} != RULES or model["type"] != "BPE" or not suffix or model.get("dropout"):
        return None
    lower, (_, by_byte) = rules["normalizer"]["normalizers"][-1], rules["pre_tokenizer"]["pretokenizers"]
    rules |= {"normalizer": lower, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, by_byte]}, "added_tokens": []}
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[k for token, k in model["vocab"].items() if token.endswith(suffix)]] = True
    return Tokenizer.from_str(json.dumps(rules)), ends


def word_encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """Texts to their ids as little-endian unsigned 32-bit bytes.

    This tokenizer drops white space and never joins what white space parts, so a text's ids are its words' ids in turn; the different
    words of a call's texts are found in arrays, encoded once and remembered. Most different words of a corpus don't come again: these
    go soon, so that they neither add up nor take the others with them. Splitting at the six ASCII spaces alone leaves all other white
    space to the tokenizer. It also parts letters from what follows them, so a word of letters and a few marks is encoded as the two.
    """
    workers = remembered("packing")  # by path: tokenizers, the bar's ids, words
    if path not in workers:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker is one of many; its threads' memory would be kept by each
        tokenizer = Tokenizer.from_file(path)
        workers[path] = (tokenizer, letters_tokenizer(path), tokenizer.encode("|", add_special_tokens=False).ids, Words(ONCE), Words(AGAIN))
        release()  # the file's rules as Python's objects
    tokenizer, letters, bar, known, again = workers[path]
    special = [x.content.encode() for x in tokenizer.get_added_tokens_decoder().values()]

    def is_word(core: bytes) -> bool:
        """Whether it is one word to the tokenizer, whatever its case."""
        if core.isalpha():  # of bytes: A-Z and a-z
            return True
        text = core.decode("utf-8", "replace")
        return text.isalpha() and unicodedata.is_normalized("NFC", text) and text.lower().isalpha()

    def learn_latin(cores: list[str]) -> list[bytes]:
        """Words of Latin letters, many in one text: their last ids part them."""
        quick, ends = letters
        found: list[bytes] = []
        for k in range(0, len(cores), 1_000):
            some = cores[k : k + 1_000]
            ids = np.array(quick.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
            if len(at) != len(some) or at[-1] != 4 * len(ids):
                raise ValueError("this tokenizer doesn't keep words apart")
            found += map(ids.tobytes().__getitem__, map(slice, [0, *at], at))
        return found

    def learn_letters(cores: list[bytes], found: dict[bytes, bytes]) -> None:
        """Words of letters, many in one text, with bars between them."""
        for k in range(0, len(cores), 5_000):
            some = cores[k : k + 5_000]
            ids = np.array(tokenizer.encode_batch_fast([b" | ".join(some).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == bar[0])
            if len(bar) != 1 or len(at) != len(some) - 1:
                raise ValueError("this tokenizer doesn't keep words apart")
            starts = [0, *(4 * (at + 1)).tolist()]
            ends = [*(4 * at).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            for core, x, y in zip(some, starts, ends, strict=True):
                found[core] = data[x:y]

    def learn_others(words: list[bytes], found: dict[bytes, bytes]) -> None:
        for k in range(0, len(words), 2_000):  # the tokenizer's own results are large
            some = words[k : k + 2_000]
            for word, encoded in zip(some, tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                found[word] = np.array(encoded.ids, "<u4").tobytes()

    def learn(words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that aren't remembered, and of those parts of theirs that aren't."""
        cores = {w: core for w in words if w[-1:] in MARKS and is_word(core := w.rstrip(MARKS))}
        parts = set(cores.values()) | {w[len(core) :] for w, core in cores.items()}
        remembered_parts = {part: store[part] for store in (known, again) for part in parts & store.keys()}
        left = [w for w in words if w not in cores]
        left += parts.difference(remembered_parts, left)
        new: dict[bytes, bytes] = {}
        if letters:
            texts = b" ".join(left).decode("utf-8", "replace").split(" ")
            latin = list(map(LATIN.fullmatch, texts)) if left else []
            new.update(zip(compress(left, latin), learn_latin(list(compress(texts, latin))), strict=True))
            left = [w for w in left if w not in new]
        learn_letters([w for w in left if is_word(w)], new)
        learn_others([w for w in left if w not in new], new)
        parts_of = new | remembered_parts
        for word, core in cores.items():
            new[word] = parts_of[core] + parts_of[word[len(core) :]]
        return new

    def encode(texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        plain_ones = [plain(t, special) for t in texts]
        split = pc.ascii_split_whitespace(pa.array(plain_ones, pa.binary()).view(pa.string()))  # it looks at bytes alone
        coded = split.values.dictionary_encode()
        different = coded.dictionary.view(pa.binary())
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(different)], different), b" ")[0].as_py().split(b" ")  # sooner than one by one
        ids = list(map(again.get, words))
        places = list(compress(range(len(ids)), map(is_none, ids)))
        fresh = [words[k] for k in places]
        second = known.forget(fresh)  # that were seen in one call before
        new = learn([w for w in fresh if w not in second])
        known.remember(new)
        again.remember(second)
        new |= second
        for k in places:
            ids[k] = new[words[k]]
        _, ends, data = pa.array(ids, pa.large_binary()).take(coded.indices).buffers()
        at = np.frombuffer(ends, np.int64)[split.offsets].tolist()
        return [data[x:y].to_pybytes() for x, y in zip(at, at[1:], strict=False)]

    return encode


def plain(text: bytes, special: list[bytes]) -> bytes:
    """The text with A-Z in lower case, so that fewer words differ, where the tokenizer, which composes characters before it lowers them
    and looks for its special strings before both, can't tell."""
    low = text.lower()
    if any(map(low.__contains__, special)):
        return text
    if low.isascii():
        return low
    return low if all(unicodedata.is_normalized("NFC", x.decode("utf-8", "replace")) for x in (text, low)) else text


def together(sizes: list[int], most: int = TOGETHER) -> Iterator[slice]:
    """Rows in turn, of so many bytes together at most, or one of more."""
    start, size = 0, 0
    for k, n in enumerate(sizes):
        if k > start and size + n > most:
            yield slice(start, k)
            start, size = k, 0
        size += n
    if sizes:
        yield slice(start, len(sizes))


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """n as a sum of powers of two, none above longest: the largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text", id: str = "doc_id", longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece, which is a sequence of its own: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length), ids.

    No sequence crosses documents and none is padded, as every length is a power of two of at most longest. A document with no
    text (or null) is its end id alone. Rows that repeat an id are packed each. Null ids stay null; other columns are ignored.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in together(list(map(len, texts))):
                out: list[list] = [[], [], [], [], [], [], []]
                docs_, starts, lengths, sums, sizes, buckets, parts = out
                for doc, whole in zip(ids[some], encode(texts[some]), strict=True):
                    whole = memoryview(whole + end)
                    n, start = len(whole) // 4, 0
                    pieces_of = binary_lengths(n, longest)
                    docs_ += [doc] * len(pieces_of)
                    sizes += [n] * len(pieces_of)
                    lengths += pieces_of
                    for length in pieces_of:
                        part = whole[4 * start : 4 * (start + length)]
                        starts.append(start)
                        sums.append(zlib.crc32(part))
                        parts.append(bytes(part) if with_ids else None)
                        start += length
                buckets += [length.bit_length() - 1 for length in lengths]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"]
    types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("text"))
    out = rows.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary")
    # Unique and without a shuffle; it counts within the input's partitions.
    out = out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return out if with_ids else out.drop("ids")


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length, so that a batch draws sequences of one length only."""
    packed.write.partitionBy("bucket").parquet(path)


def op2(spark, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
