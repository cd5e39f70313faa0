import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import exact_dedup, line_dedup, run_index, simhash, suffix_dedup
from skein.llm.components import components
from skein.operators.suffix import suffix_array

from .conftest import read

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# Exact dedup


def brute_exact(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(-(2**63) if i is None else i)
    return sorted((i, keep(groups[t or ""]), len(groups[t or ""])) for i, t in ((-(2**63) if i is None else i, t) for i, t in rows))


def test_exact_dedup(spark, edge, empty):
    for df in (read(spark), edge):
        for keep in ("min", "max"):
            exp = brute_exact(texts_of(df), min if keep == "min" else max)
            for how in ({}, {"filter_bytes": 0}, {"digest": lambda c: F.substring(exact_dedup.sha256_digest(c), 1, 1)}):
                got = exact_dedup.exact_dedup(df, keep=keep, **how).collect()
                low = -(2**63)
                assert sorted((low if r["doc_id"] is None else r["doc_id"], low if r["keep_id"] is None else r["keep_id"], r["group_size"]) for r in got) == exp
                assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("memtables, fan", [(8, 8), (5, 2), (1, 3)])
def test_index_grows_by_runs(spark, tmp_path, memtables, fan):
    index = exact_dedup.DigestIndex(spark, str(tmp_path), "min", memtables, fan)
    for first in (0, 5):
        index.add(spark.range(first, first + 7).select("id", F.unhex(F.sha2((F.col("id") % 4).cast("string"), 256)).alias("digest")))
    assert sum(runs for _, runs in index.runs) == 2 * memtables
    for folder in (f for level in tmp_path.iterdir() for f in level.glob("run=*")):
        for file in folder.glob("*.parquet"):
            digests = [r["digest"] for r in spark.read.parquet(str(file)).collect()]
            assert digests == sorted(set(digests))  # a run has each digest once, in order
    rows = index.compact().collect()
    assert sorted((r["keep"], r["n"]) for r in rows) == [(0, 3), (1, 4), (2, 4), (3, 3)]
    assert len(list(tmp_path.iterdir())) == 1 and index.runs[0][1] == 1
    index.add(spark.range(20, 21).select("id", F.unhex(F.sha2(F.lit("0"), 256)).alias("digest")))
    assert {(r["keep"], r["n"]) for r in index.compact().collect()} >= {(0, 4)}


# Line dedup


def brute_lines(rows, few):
    lines = []
    for d, t in sorted(set((-(2**63) if i is None else i, t or "") for i, t in rows)):
        for no, line in enumerate(t.split("\n")):
            words = tuple(re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ").split(" "))
            if words != ("",):
                lines.append((d, no, words))
    seen, gone = [], defaultdict(lambda: (set(), set()))
    for d, no, w in lines:
        if w in seen:
            gone[d][0].add(no)
            continue
        if len(w) >= few and any(len(o) >= few and near(w, o) for o in seen):
            gone[d][1].add(no)
        seen.append(w)
    return gone


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def lines_collection(spark):
    rng, rows = random.Random(4), []
    base = [[rng.choice("abcde") for _ in range(rng.randint(1, 7))] for _ in range(6)]
    for d in range(40):
        out = []
        for _ in range(rng.randint(0, 4)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = [rng.choice("abcDE")] * rng.randint(0, 1)
            out.append(rng.choice(["", " ", "\t"]).join([""]) + " ".join(w))
        rows.append((d, "\n".join(out), "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_line_dedup(spark, edge, empty):
    for df, few in ((read(spark), 8), (lines_collection(spark), 3), (edge, 8)):
        rows = texts_of(df)
        gone = brute_lines(rows, few)
        got = line_dedup.dedup_lines(df, fewest_words=few)
        assert set(df.columns) <= set(got.columns)
        found = sorted(((-(2**63) if r["doc_id"] is None else r["doc_id"]), r["text"] or "", r["n_exact"], r["n_near"]) for r in got.collect())
        exp = []
        for i, t in rows:
            i = -(2**63) if i is None else i
            exact, close = gone[i]
            exp.append((i, "\n".join(x for no, x in enumerate((t or "").split("\n")) if no not in exact | close), len(exact), len(close)))
        assert found == sorted(exp)
    assert line_dedup.dedup_lines(empty).count() == 0
    other = edge.select("doc_id", "text", "did", "maybe")
    assert sorted(map(str, line_dedup.dedup_lines(other).select("did", "maybe").collect())) == sorted(map(str, other.select("did", "maybe").collect()))


# SimHash


def brute_fingerprint(text):
    words = [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORDS.findall(text or "")]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, values):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 3:
                x, y = root(ids[a]), root(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints_and_groups(spark, edge, empty):
    for df in (read(spark), edge.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = texts_of(df)
        values = [brute_fingerprint(t) for _, t in rows]
        exp = brute_components([i for i, _ in rows], values)
        got = {r["doc_id"]: (r["fingerprint"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
        assert got == {i: (v, exp[i]) for (i, _), v in zip(rows, values)}
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count() and sum(r["doc_id"] is None for r in rows) == 1
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("most, block", [(simhash.MOST, simhash.BLOCK), (6, 300), (0, 1)])
def test_anchors_cover_every_link(spark, monkeypatch, most, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # small: anchors that go on over several blocks, and pass on to three codewords
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(300)]
    for v in values[:200]:
        for _ in range(2):
            w = v
            for b in rng.sample(range(64), rng.randint(0, 4)):
                w ^= 1 << b
            values.append(w)
    chain = [rng.getrandbits(64)]
    for _ in range(150):  # a long chain, and with it large groups at some anchors
        chain.append(chain[-1] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(12))
    values = list(dict.fromkeys(values + chain))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = {r["node"] % 2**64: r["root"] for r in components(simhash.links(df, most=most)).collect()}
    exp = brute_components(signed, values)
    classes = defaultdict(set)
    for v, s in zip(values, signed):
        classes[exp[s]].add(v)
    for members in classes.values():
        assert len(members) == 1 or len({got[v] for v in members}) == 1
    assert len({got[v] for v in got}) == sum(len(m) > 1 for m in classes.values())


def test_large_groups_keep_what_is_reachable():
    rng = np.random.default_rng(3)
    start = rng.integers(0, 2**63, dtype=np.uint64)
    values = np.unique(np.array([start ^ np.uint64((1 << int(a)) ^ (1 << int(b))) for a, b in rng.integers(0, 40, (300, 2))], np.uint64))
    a, b = simhash.linked(np.zeros(len(values), np.int64), values)
    assert len(a) < len(values) and (np.bitwise_count(a ^ b) <= 3).all()
    ids = values.tolist()
    exp = brute_components(ids, ids)
    up = {i: i for i in ids}
    for _ in range(len(ids)):
        for x, y in zip(a.tolist(), b.tolist()):
            up[x] = up[y] = min(up[x], up[y])
    assert len(set(up.values())) == len(set(exp.values()))


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + k, 501 + k) for k in range(60)] + [(1000, 1001 + k) for k in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    up = {x: x for p in pairs for x in p}
    for _ in range(len(up)):
        before = dict(up)
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
        if before == up:
            break
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: up[x] for x in linked}


# Repeated strings


def test_run_length_index():
    rng = random.Random(1)
    for _ in range(200):
        text = np.array([rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 60))], np.uint8)
        data, order = text.tobytes(), suffix_array(text).tolist()
        index = run_index.RunLengthIndex(text, 5)
        assert sum(index.lengths.tolist()) == len(data) and len(index.samples) <= len(index.symbols) + 1
        before, common = index.matching_statistics()
        for k, i in enumerate(order):
            j = order[k - 1] if k else -1
            n = next((m for m in range(len(data) + 1) if max(i, j) + m >= len(data) or data[i + m] != data[j + m]), 0) if k else 0
            assert before[i] == j and (common[i] >= 5) == (n >= 5) and (n >= 5 or common[i] == n)


def brute_strings(rows, length):
    seen, out = set(), {}
    for i, t in sorted(set((-(2**63) if i is None else i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0], hashlib.md5(r[1]).digest())):
        marks, own = bytearray(len(t)), []
        for k in range(len(t) - length + 1):
            if t[k : k + length] in seen:
                marks[k : k + length] = b"\1" * length
            seen.add(t[k : k + length])
        kept = bytes(c for c, m in zip(t, marks) if not m)
        out[i, t] = (len(t), sum(marks), sum(m and (not k or not marks[k - 1]) for k, m in enumerate(marks)), hashlib.sha256(kept).hexdigest())
    return out


def strings_collection(spark):
    rng, rows = random.Random(9), []
    parts = ["".join(rng.choice("ab ") for _ in range(n)) for n in (20, 50, 90, 130)] + ["a" * 70, "ab" * 40]
    for d in range(60):
        rows.append((d % 55, "".join(rng.choice(parts)[rng.randint(0, 5) :] for _ in range(rng.randint(0, 5))), "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_repeated_strings(spark, edge, empty):
    for df, length in ((read(spark), 100), (strings_collection(spark), 100), (strings_collection(spark), 12), (edge, 100), (edge, 3)):
        rows = texts_of(df)
        exp = brute_strings(rows, length)
        got = suffix_dedup.repeated_strings(df, length=length).collect()
        low = -(2**63)
        found = sorted((low if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got)
        assert found == sorted((low if i is None else i, *exp[low if i is None else i, (t or "").encode()]) for i, t in rows)
    assert suffix_dedup.repeated_strings(empty).count() == 0
