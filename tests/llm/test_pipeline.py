import hashlib
import inspect
import os
import random
import tracemalloc
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skein.llm import line_quality, near_copies, packing, run_index, suffix_dedup, token_counts
from skein.llm.queries import ORACLE_SQL, QUERIES
from skein.session import tables_dir

from .conftest import read


def test_stages(spark, edge, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    long = "a long enough text of many different words " + " ".join(f"w{k}" for k in range(80))
    extra = edge.unionByName(spark.createDataFrame([(20 + k, long + f" {k // 2}") for k in range(4)], "doc_id long, text string"), allowMissingColumns=True)
    for docs in (read(spark), extra, empty):
        before = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, before, "").cache()
            assert after.columns == docs.columns, name
            if name == "quality_rules":
                assert after.count() <= before.count()
            if name == "line_dedup":
                assert after.count() == before.count()
            if name == "near_dedup":
                assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
            if name == "mixing":
                assert max(Counter(r["doc_id"] for r in after.collect()).values(), default=0) <= 2
            before = after
        assert corpus_pipeline.packing(spark, before, "").filter("start = 0").count() == before.count()


def test_stages_leave_only_the_tables_that_their_results_read(spark):
    """what a stage leaves is on disk while the next ones run; near-dedup's limit was passed with line dedup's tables."""

    def tables():
        top = tables_dir(spark).removeprefix("file:")
        return set(os.listdir(top)) if os.path.isdir(top) else set()

    for stage, read_later in ((corpus_pipeline.quality_rules, {"many-lines", "removed-words"}), (corpus_pipeline.line_dedup, {"gone-lines"})):
        before = tables()
        rows = stage(spark, read(spark), "")
        assert {n.rpartition("-")[0] for n in tables() - before} <= read_later
        assert rows.count() > 0 and rows.filter("length(text) > 0").count() > 0


def brute_near(rows):
    sets, up = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i for i in up if root(i) == i}


def test_near_dedup_is_all_pairs_at_four_fifths(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(1, 150)))) for k in range(150)]
    for k in range(150, 500):  # copies of copies, most of them near the bound
        words = rng.choice(rows)[1].split() if k < 400 else rows[0][1].split() + ["x"] * 100
        for _ in range(rng.randint(0, 1 + len(words) // 30)):
            words[rng.randrange(len(words))] = rng.choice(["new", "Word"])
        rows.append((k, " ".join(words)))
    rows += [(500, ""), (501, None), (502, " \n"), (503, rows[3][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(rows) and len(got) < 450


def test_run_is_its_stages(spark):
    docs = read(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert Counter(map(tuple, run.select(columns).collect())) == Counter(map(tuple, docs.select(columns).collect()))


def test_queries_cover_their_tables(spark):
    assert sorted({n.split("_")[0] for n in QUERIES}) == sorted(f"op{k}" for k in range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    for name in ("op1_run_length_index", "op6_mix_sources", "op8_secret_scan", "op9_line_quality", "op10_exact_dedup"):
        rows = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert rows.select("doc_id").distinct().count() == read(spark).count() == rows.count()
    base = QUERIES["op8_secret_scan"](spark, "/root/testdata/sf0.001").filter("n_assign + n_access + n_hex = 0").select("base_sha256").distinct().collect()
    assert [r[0] for r in base] == [hashlib.sha256(b"").hexdigest()]


def test_workers_forget_other_operators(spark):
    """F1 of round 3: near-dedup ran in Python workers that still held packing's words, and passed an executor's memory."""

    def encoder():
        encode = packing.word_encoder(packing.default_tokenizer())
        return encode, inspect.getclosurevars(encode).nonlocals["known"]

    encode, known = encoder()
    before = encode([b"some words to remember"])
    assert b"remember" in known and encoder()[1] is known
    near_copies.Shingles()
    encode, known = encoder()
    assert not known and encode([b"some words to remember"]) == before


def test_lines_are_hashed_once_for_each_text(spark):
    """F3 of round 3: Spark split and hashed each text once more for a filter of its own, and compared all pairs of a text's lines."""
    texts = ["one two\nthree\none two\n\n ONE  two\nfour five six", "a b c\nd", "x\nx\nx", " \n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    found = line_quality.hashed_lines(rows.select("_id", line_quality.normalised_lines(F.col("_text")).alias("_lines")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "array_distinct(_lines" not in plan
    got = [(r["_id"], r["place"], r["words"], r["all_lines"], r["all_words"]) for r in found.orderBy("_id", "place").collect()]
    assert got == [(0, 0, 2, 3, 6), (0, 1, 1, 3, 6), (0, 2, 2, 3, 6), (0, 3, 2, 3, 6), (0, 4, 3, 3, 6), (1, 0, 3, 2, 4), (1, 1, 1, 2, 4), (2, 0, 1, 1, 1), (2, 1, 1, 1, 1), (2, 2, 1, 1, 1)]


def test_pre_tokens_are_encoded_together():
    """F5 of round 3: each new pre-token was a text of its own to the tokenizer, and each document a call."""
    text = "we're 'sx 'S ''' 's x' \n\n  y\t z a b\x1cc d\x85e ́f <|endoftext|> é日本語123 !?​ #\n" + " ".join(f"word{k} {chr(0x100 + k)}x'll {k}" for k in range(9000))
    count, calls = token_counts.PreTokenCounter(token_counts.default_tokenizer()), []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            calls.append(len(texts))
            return tokenizer.encode_batch_fast(texts, **more)

    tokenizer, count.tokenizer = count.tokenizer, Counted()
    pieces = count.pieces(text)
    assert "".join(pieces) == text
    assert count.counts(pieces) == [len(tokenizer.encode(p, add_special_tokens=False).ids) for p in pieces]
    assert sum(calls) < 50 < 20_000 < len(count.known)


def test_long_repeats_are_found_within_a_cores_cache():
    """F4 of round 3: anchors and indexes were made of megabytes at once, in arrays of eight times that, each read from memory anew."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)).encode() for _ in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(range(len(texts)))], names=["text", "content"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in suffix_dedup._emit_anchors(100)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 10_000 and most < 16 << 20
    for text in (b"", b"abc", b"ab" * 300, bytes(rng.choice(b"ab") for _ in range(2000)), texts[0] + texts[1] + texts[0]):
        at = np.frombuffer(text, np.uint8)
        index = run_index.RunLengthIndex(at, 100)
        for one, two, n in zip(index.samples.tolist(), index.before.tolist(), index.common.tolist(), strict=True):
            assert n == (min(100, len(os.path.commonprefix([text[one:], text[two:]]))) if two >= 0 else 0)
        assert index.samples.tolist() == sorted({s - 1 for s in index.starts.tolist() if s > 0} | ({len(text) - 1} if text else set()))
        late = run_index.later_copies(at, 100, len(text) - np.arange(len(text)) >= 100)
        seen = set()
        for k in range(len(text)):
            part = text[k : k + 100]
            assert bool(late[k]) == (len(part) == 100 and part in seen)
            seen.add(part)
