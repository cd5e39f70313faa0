"""Secret scans with a worklist of decoded layers: URL, Unicode escapes, base64 and compressed bytes, nested in any order."""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import documents, small_batches, whole_text

#: The kinds in their order, their patterns, and the fewest characters that count.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run that is shorter fails
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: One of these is in every text, in lower case, that ASSIGN matches.
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over line breaks: lines of its characters alone, but for what is before the first and after the last.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n|\n|\r)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Percent-encoded bytes among characters that stand for themselves, and how compressed bytes begin.
MIXED = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~+/-])++")
VALID = re.compile("[^\udc80-\udcff]+")
#: Characters of a stretch of text among other bytes, at least.
STRETCH = 12
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: No pattern and no run of a decoder has one of these characters, nor do decoders take them away.
BREAK = re.compile(r"""[^A-Za-z0-9+/_.=~"':\s%\\{}&#;~-]""")
#: Characters that decoders may make of one document before it is marked as cut: any number, unless a caller sets a bound.
MOST_DECODED = None
#: Characters after which a text is cut at the next break, what is inflated at once, and the memory of a decompressor's window.
WINDOW, PIECE, MOST_MEMORY = 4 << 20, 1 << 20, 256 << 20


def matches(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base rules: each kind leftmost and without overlap, by start and then kind."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


class Layer:
    """A text and, for each of its characters, where it lies in the document; fresh: the characters that a decoder made."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None, fresh: np.ndarray | None = None):
        self.text, self._start, self._end, self._fresh = text, start, end, fresh

    @classmethod
    def parts_of(cls, text: str) -> Iterator[Layer]:
        """The document itself: whole, or in windows if it is long."""
        if len(text) <= WINDOW:
            yield cls(text)
            return
        at = 0
        for part in windows(_pieces(text)):
            yield cls(part, np.arange(at, at + len(part)), np.arange(at + 1, at + len(part) + 1))
            at += len(part)

    def place(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self._start is None else (int(self._start[a:b].min()), int(self._end[a:b].max()))

    def is_fresh(self, a: int, b: int) -> bool:
        return self._fresh is not None and bool(self._fresh[a:b].any())

    def replaced(self, parts: list[tuple[int, int, str]]) -> Layer:
        """parts: start, end, decoded text; what lies between them stays."""
        n = len(self.text)
        start = np.arange(n) if self._start is None else self._start
        end = np.arange(1, n + 1) if self._end is None else self._end
        fresh = np.zeros(n, bool) if self._fresh is None else self._fresh
        text, s, e, f, at = [], [], [], [], 0
        for a, b, new in [*parts, (n, n, "")]:
            text += [self.text[at:a], new]
            s += [start[at:a], np.full(len(new), start[a:b].min() if b > a else 0)]
            e += [end[at:a], np.full(len(new), end[a:b].max() if b > a else 0)]
            f += [fresh[at:a], np.ones(len(new), bool)]
            at = b
        return Layer("".join(text), np.concatenate(s), np.concatenate(e), np.concatenate(f))

    def made(self, a: int, b: int, new: str) -> Layer:
        """A layer of its own that is all from one place."""
        p, q = self.place(a, b)
        return Layer(new, np.full(len(new), p), np.full(len(new), q), np.ones(len(new), bool))


def _url(layer: Layer) -> list[tuple[int, int, str]]:
    """The valid parts of percent-encoded runs; bytes that aren't UTF-8 stay as they are."""
    parts = []
    for m in URL.finditer(layer.text) if "%" in layer.text else ():
        text, at, done = bytes.fromhex(m[0].replace("%", "")).decode(errors="surrogateescape"), m.start(), 0
        for part in VALID.finditer(text):
            at += 3 * (part.start() - done)  # each byte between is a character here
            end = at + 3 * len(part[0].encode())
            parts.append((at, end, part[0]))
            at, done = end, part.end()
    return parts


def _url_packed(layer: Layer) -> Iterator[Layer]:
    """Layers of percent-encoded runs that hold compressed bytes, of which letters and the like may stand for themselves."""
    for m in MIXED.finditer(layer.text) if "%" in layer.text else ():
        if "%" not in m[0]:
            continue
        data = unquote_to_bytes(m[0])
        starts = {0, *(x.start() for x in MAGIC.finditer(data))}
        for start in sorted(starts):
            if _decompressor(data[start : start + 8]) is None:
                continue
            for text in _texts(data[start:]):
                yield layer.made(m.start(), m.end(), text)


def _unicode(layer: Layer) -> list[tuple[int, int, str]]:
    parts = []
    if not any(x in layer.text for x in ("\\u", "\\U", "\\x", "%u", "&#")):
        return parts
    for m in UNICODE.finditer(layer.text):
        try:
            if m[0].startswith("\\u") and not m[0].startswith("\\u{"):  # a run: pairs of surrogates stand for one character
                new = bytes.fromhex(m[0].replace("\\u", "")).decode("utf-16-be")
            else:
                new = chr(int(m[0][2:-1]) if re.fullmatch("&#[0-9]+;", m[0]) else int(re.sub(r"^(&#[xX]|\\u\{|\\[uUx]|%u)|[;}]$", "", m[0]), 16))
                new.encode()
            parts.append((m.start(), m.end(), new))
        except (ValueError, OverflowError):
            pass
    return parts


def _decompressor(data: bytes):
    """What inflates bytes that begin as these do, or None."""
    if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and (data[0] * 256 + data[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=MOST_MEMORY)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor(max_window_size=MOST_MEMORY).stream_reader(data, read_across_frames=True)
    return None


def inflated(data: bytes) -> Iterator[bytes]:
    """What compressed bytes hold, piece by piece, all members of it, up to where they are damaged."""
    try:
        while (one := _decompressor(data)) is not None:
            if isinstance(one, zstandard.ZstdDecompressionReader):
                while piece := one.read(PIECE):
                    yield piece
                return
            while not one.eof:
                piece = one.decompress(data, PIECE)
                data = one.unconsumed_tail if hasattr(one, "unconsumed_tail") else b""
                if piece:
                    yield piece
                elif not data:
                    break  # it ends too soon
            data = one.unused_data
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        pass


def windows(pieces: Iterable[str], size: int = 0) -> Iterator[str]:
    """A text that comes in pieces, cut at breaks: no pattern and no decoder's run goes over one, so that nothing is cut apart.

    Between breaks a window grows as long as it must.
    """
    held, length = [], 0
    for piece in pieces:
        held.append(piece)
        length += len(piece)
        if length >= (size or WINDOW) and BREAK.search(piece):
            at = len(piece) - BREAK.search(piece[::-1]).start()
            yield "".join(held[:-1]) + piece[:at]
            held, length = [piece[at:]], len(piece) - at
    if length:
        yield "".join(held)


def _pieces(text: str) -> Iterator[str]:
    return (text[k : k + PIECE] for k in range(0, len(text), PIECE))


def _texts(data: bytes) -> Iterator[str]:
    """The text that bytes are, or hold compressed, in windows. Nothing if they hold no text."""
    held: set[bytes] = set()
    source = lambda: iter((data,))
    while True:
        total = shown = 0
        try:
            for text in codecs.iterdecode(source(), "utf-8"):
                total += len(text)
                shown += sum(c.isprintable() or c in "\n\r\t" for c in text)
            if total and shown >= 0.9 * total:
                yield from windows(codecs.iterdecode(source(), "utf-8"))
                return
        except UnicodeDecodeError:
            pass
        if _decompressor(next(source(), b"")) is None:
            return
        packed = b"".join(source())
        if packed in held:  # compressed layers may lie in one another, or hold themselves
            return
        held.add(packed)
        source = lambda packed=packed: inflated(packed)


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """start, end and characters of base64 runs that go over line breaks.

    Lines that aren't of the run may lie next to it. So besides all lines that follow one another, those of equal length are
    tried, with and without the line before them and the one after them.
    """
    for m in WRAPPED.finditer(text) if "\n" in text or "\r" in text else ():
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in LINE.finditer(m[0])]
        ranges, first = {(0, len(lines))}, 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or lines[k][1] - lines[k][0] != lines[first][1] - lines[first][0]:
                ranges |= {(a, b) for a in (max(0, first - 1), first) for b in (k, min(len(lines), k + 1))}
                first = k
        for a, b in sorted(ranges):
            run = "".join(text[p:q] for p, q in lines[a:b])
            if b - a > 1 and len(run) >= 16:
                yield lines[a][0], lines[b - 1][1], run


def _utf16(data: bytes) -> str:
    """The text of bytes of which every second one is mostly zero, or an empty one."""
    for zeros, name in ((data[1::2], "utf-16-le"), (data[0::2], "utf-16-be")):
        if len(data) >= 8 and 2 * zeros.count(0) > len(zeros):
            return data[: len(data) & ~1].decode(name, "ignore")
    return ""


def _parts(data: bytes) -> Iterator[str]:
    """What is readable in bytes whose start may be of something else: stretches of text, of UTF-16, and what compressed bytes hold."""
    for part in VALID.finditer(data.decode(errors="surrogateescape")):
        if len(part[0]) >= STRETCH and sum(c.isprintable() or c in "\n\r\t" for c in part[0]) >= 0.9 * len(part[0]):
            yield part[0]
    if text := _utf16(data):
        yield text
    for m in MAGIC.finditer(data):
        yield from _texts(data[m.start() :])


def _base64(layer: Layer) -> Iterator[Layer]:
    """Layers of the base64 runs that hold text, or compressed text. What stands before a run may be of its characters, like a path
    that ends there: a run that isn't text as a whole is decoded from each of its first four characters on, for the parts that are."""
    runs = ((m.start(), m.end(), m[0]) for m in BASE64.finditer(layer.text))
    for start, end, run in chain(runs, _wrapped(layer.text)):
        body, whole = run.rstrip("=").replace("-", "+").replace("_", "/"), False
        for phase in range(4):
            part = body[phase:]
            if len(part) % 4 == 1:
                part = part[:-1]
            try:
                data = base64.b64decode(part + "=" * (-len(part) % 4))
            except (binascii.Error, ValueError):
                continue
            if not phase and len(body) % 4 != 1:
                for text in _texts(data):
                    whole = True
                    yield layer.made(start, end, text)
                if whole:
                    break
            for text in _parts(data):
                yield layer.made(start, end, text)


def _decoded(layer: Layer) -> Iterator[Layer]:
    """The layers that one decoding makes of a layer, each when it is asked for."""
    yield from _base64(layer)
    yield from _url_packed(layer)
    for decoder in (_url, _unicode):
        if parts := decoder(layer):
            yield layer.replaced(parts)


def scan(text: str, most_decoded: int | None = MOST_DECODED) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int, bool]:
    """Base spans, all spans, the number of layers that were rescanned, and whether most_decoded cut the work short.

    Layers are made one at a time, scanned at once, and taken to their end before the next: only one chain of them is in memory.
    """
    base = matches(text)
    spans, seen, layers, made, cut = set(base), set(), 0, 0, False
    work = [Layer.parts_of(text)]
    while work and not cut:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer._fresh is not None:
            digest = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass") + layer._start.tobytes() + layer._end.tobytes(), digest_size=16).digest()
            if digest in seen:  # as it was before: a cycle, or two ways to one layer
                continue
            seen.add(digest)
            layers += 1
            spans.update((kind, *layer.place(a, b)) for kind, a, b in matches(layer.text) if layer.is_fresh(a, b))
            made += int(layer._fresh.sum())
            cut = most_decoded is not None and made > most_decoded
        work.append(_decoded(layer))
    return base, sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])), layers, cut


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>, layers int, cut boolean"


def secret_spans(docs: DataFrame, text: str = "text", id: str = "doc_id", most_decoded: int | None = MOST_DECODED) -> DataFrame:
    """One row per row of docs: doc_id, base and spans (kind, start, end in code points), layers, cut.

    Decoded layers are scanned as the text is; what is found there is given the place of the encoded run in the text. Null and
    empty texts have no spans. Rows are judged alone: ids may be null or repeat, and other columns are ignored.
    """
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                found = [scan(x, most_decoded) for x in part.column(1).to_pylist()]
                base, spans = ([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[k]] for f in found] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(base, span), pa.array(spans, span), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.bool_())],
                    names=["doc_id", "base", "spans", "layers", "cut"],
                )

    return docs.select(F.col(id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, SCHEMA)


def op8(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def line(column):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select("doc_id", *map(count, KINDS), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), "layers", "cut")
