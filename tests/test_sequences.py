import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import bits, cleaning
from skein.operators import access, kmers, parse, report, suffix
from skein.plans import sequences

GOLDEN = {
    "ananab": [(0, 1, 5), (5, 98, 1)],
    "nx": [(0, 110, 1), (1, 120, 1)],
    "nan": [(0, 2, 3)],
    "na": [(0, 4, 2)],
    "bananas": [(0, 0, 6), (6, 115, 1)],
    "": [],
}


def brute_parse(ref: bytes, data: bytes):
    order = sorted(range(len(ref)), key=lambda i: ref[i:])
    out, i = [], 0
    while i < len(data):
        n = 0
        while i + n < len(data) and data[i : i + n + 1] in ref:
            n += 1
        if n <= 1:
            out.append((i, data[i], 1))
            i += 1
        else:
            out.append((i, next(p for p in order if ref[p : p + n] == data[i : i + n]), n))
            i += n
    return out


def test_golden_phrases():
    reference = parse.Reference(b"banana$")
    assert reference.sa.tolist() == [6, 5, 3, 1, 0, 4, 2]
    for text, phrases in GOLDEN.items():
        assert reference.parse(text.encode()) == phrases


def test_parse_and_suffixes_against_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        letters = rng.choice([b"ab", b"abc\0", bytes(range(97, 110))])
        ref = bytes(rng.choice(letters) for _ in range(rng.randint(0, 80)))
        data = bytes(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        if ref and rng.random() < 0.5:
            p = rng.randrange(len(ref))
            data += ref[p : p + 30] + data
        found = parse.Reference(ref)
        assert found.sa.tolist() == sorted(range(len(ref)), key=lambda i: ref[i:])
        assert found.parse(data) == brute_parse(ref, data)


def test_parse_beyond_a_part(monkeypatch):
    reference = parse.Reference(b"abcabdabe" * 50)
    data = (b"abcabdabe" * 50 + b"x") * 3000
    assert len(data) > 1 << 20
    phrases = reference.parse(data)
    assert phrases[0] == (0, phrases[0][1], 450) and sum(p[2] for p in phrases) == len(data)


def test_distributed_suffix_array(spark):
    data = b"mississippi\0\0banana\0"
    table = spark.createDataFrame([(k, b) for k, b in enumerate(data)], "pos long, symbol int")
    rows = sorted(map(tuple, suffix.suffix_array_table(table).collect()))
    assert [p for _, p in rows] == sorted(range(len(data)), key=lambda i: data[i:]) == suffix.suffix_array(np.frombuffer(data, np.uint8)).tolist()


@pytest.fixture(scope="module")
def parsed(spark):
    reference = parse.Reference(b"the cat sat on the mat; the dog sat on the log\xc3\xa9")
    texts = ["the cat sat on the log", None, "", "zzz", "the dog ate é the mat" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return reference, {k: (t or "").encode() for k, t in enumerate(texts)}, parse.parse(rows, "id", F.encode("text", "UTF-8"), reference)


def test_roundtrip_stats_and_coverage(parsed):
    reference, texts, found = parsed
    assert {r["id"]: bytes(r["data"]) for r in parse.decoded(found, "id", reference).collect()} == texts
    exp = {k: brute_parse(reference.text, t) for k, t in texts.items()}
    for r in parse.phrase_stats(found, "id").collect():
        assert (r["n_phrases"], r["n_literal"]) == (len(exp[r["id"]]), sum(p[2] == 1 for p in exp[r["id"]]))
    for r in parse.coverage(found, "id", len(reference.text)).collect():
        marks = {x for _, p, n in exp[r["id"]] if n > 1 for x in range(p, p + n)}
        assert r["covered"] == len(marks) and r["outside"] == 0


def test_access_spans_and_extracts(spark, parsed):
    reference, texts, found = parsed
    phrases = parse.phrase_rows(found, "id")
    asked = [(k, p) for k, t in texts.items() for p in range(len(t))]
    got = access.access(phrases, spark.createDataFrame(asked, "id long, p long"), "id", reference).collect()
    assert {(r["id"], r["p"]): r["symbol"] for r in got} == {(k, p): texts[k][p] for k, p in asked}
    ranges = [(k, p, min(37, len(t) - p)) for k, t in texts.items() for p in range(0, len(t), 11)]
    got = access.extracts(phrases, spark.createDataFrame(ranges, "id long, p long, n long"), "id", reference).collect()
    assert {(r["id"], r["p"]): bytes(r["data"]) for r in got} == {(k, p): texts[k][p : p + n] for k, p, n in ranges}


def test_cache_statistics(spark):
    reference = parse.Reference(b"banana$")
    once = spark.createDataFrame([(0, "ananab")], "id long, text string")
    twice = spark.createDataFrame([(0, "ananab"), (1, "ananab")], "id long, text string")
    first = parse.cache_stats(parse.refinements(once, "id", "text", reference), 7, 4).first()
    assert (first["hits"], first["misses"], first["entries"]) == (0, 5, 5)
    both = parse.cache_stats(parse.refinements(twice, "id", "text", reference), 7, 4).first()
    assert (both["hits"], both["misses"], both["entries"]) == (5, 5, 5)
    trace = {r["id"]: r for r in parse.bucket_trace(parse.refinements(twice, "id", "text", reference), 4).collect()}
    assert trace[0]["total_hits"] == 0 and trace[0]["bucket_hit_sequence"] == "" and trace[1]["total_hits"] == 5
    assert parse.probing_slots(5, 7) == 8


def test_hit_rates(spark, parsed):
    reference, texts, found = parsed
    rows = {(r["k"], r["id"]): r for r in parse.predicted_hits(found, "id", [2, 8]).collect()}
    for k in (2, 8):
        phrases = [(len(t) - s, n) for t in texts.values() for s, _, n in brute_parse(reference.text, t)]
        assert rows[k, None]["lookups"] == sum(left >= k for left, _ in phrases)
        assert rows[k, None]["hits"] == sum(left >= k and n >= k for left, n in phrases)


def brute_clean(data: bytes):
    out, counts, start, inside = bytearray(), [0, 0, 0, 0], True, False
    for c in data:
        if c == 0:
            counts[3] += 1
        elif inside:
            if c in b"\n\r":
                inside, start = False, True
        elif start and c == ord(">"):
            inside = True
            counts[1] += 1
        elif c in b" \t\n\x0b\x0c\r":
            counts[2] += 1
            start = start or c in b"\n\r"
        else:
            start = False
            out.append(c if c in b"ACGT" else ord("A"))
            counts[0] += c not in b"ACGT"
    return bytes(out), counts


def test_cleaning_against_a_byte_loop(spark):
    rng = random.Random(2)
    texts = [">h\r\nACGT\0a\n  >x y\nG>G\r>last", "", None] + ["".join(rng.choice("ACGTacé> \n\r\t\0") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    columns = cleaning.cleaning_counters(F.col("text"))
    for r in rows.select("id", cleaning.clean_sequence(F.col("text")).alias("clean"), *[c.alias(k) for k, c in columns.items()]).collect():
        clean, counts = brute_clean((texts[r["id"]] or "").encode())
        assert r["clean"].encode() == clean
        assert [r["replacement_count"], r["header_lines_removed"], r["whitespace_characters_removed"], r["nul_bytes_removed"]] == counts, texts[r["id"]]
        assert r["sequence_length"] == len(clean)


def test_packed_kmers_and_bits(spark):
    row = spark.createDataFrame([("T" * 16, "ACGT" * 4, 0, 37)], "a string, b string, x int, y int").select(
        bits.pack_kmer(F.col("a")).alias("a"), bits.pack_kmer(F.col("b")).alias("b"), bits.roll_kmer(bits.pack_kmer(F.col("b")), F.lit("A")).alias("r"),
        bits.bits_required(F.col("x")).alias("x"), bits.bits_required(F.col("y")).alias("y"), bits.common_bits(F.lit(5), F.lit(7)).alias("c"), bits.common_bits(F.lit(5), F.lit(5)).alias("e"),
    ).first()
    assert tuple(row) == (4294967295, int("0123" * 4, 4), int("123" + "0123" * 3 + "0", 4), 1, 6, 14, 32)


def test_kmer_index_and_directory(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("ACGT") for _ in range(300)) + "ACGT" * 20
    reference = parse.Reference(text.encode())
    suffixes = spark.createDataFrame(list(enumerate(reference.sa.tolist())), "sa_idx long, pos long")
    index = kmers.kmer_index(suffixes, text)
    exp: dict[int, list[int]] = {}
    for k, p in enumerate(reference.sa.tolist()):
        if p + 16 <= len(text):
            exp.setdefault(sum("ACGT".index(c) << 2 * (15 - j) for j, c in enumerate(text[p : p + 16])), []).append(k)
    assert {(r["key"], r["sa_start"], r["sa_end"]) for r in index.collect()} == {(k, v[0], v[-1]) for k, v in exp.items()}
    full = sorted({k >> 16 for k in exp})
    for r in kmers.bucket_directory(index).collect():
        b = r["bucket"]
        assert r["entries"] == sum(k >> 16 == b for k in exp) if b in full else r["entries"] == 0
        if b not in full:
            near = [max([x for x in full if x < b], default=None), min([x for x in full if x > b], default=None)]
            assert r["nearest"] == min((x for x in near if x is not None), key=lambda x: ((b ^ x).bit_length(), x))
    texts = spark.createDataFrame([(0, text[5:60]), (1, "ACGT" * 10)], "id long, text string")
    phrases = parse.phrase_rows(parse.parse(texts, "id", "text", reference), "id")
    stats = {r["id"]: r for r in kmers.seed_stats(kmers.seeded(phrases, texts, index, "id"), index, "id").collect()}
    assert (stats[0]["singleton_hits"], stats[0]["misses"]) == (1, 0) and stats[1]["range_hits"] == 1


def test_queries_roundtrip_on_given_tables(spark):
    from skein import plans

    rows = plans.QUERIES["lz_roundtrip"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r["doc_id"]: r["md5"] for r in rows} == {k: hashlib.md5(t.encode()).hexdigest() for k, t in texts.items()}


def test_fast_parse_against_its_rule(spark):
    rng = random.Random(7)
    text = bytes(rng.choice(b"ACGT") for _ in range(300))
    reference = parse.Reference(text)
    keys = {text[p : p + 8] for p in range(len(text) - 15)}
    order = {w: next(p for p in reference.sa.tolist() if text[p : p + 8] == w and p + 16 <= len(text)) for w in keys}
    code = lambda w: sum(b"ACGT".index(c) << 2 * (7 - k) for k, c in enumerate(w))
    data = bytes(rng.choice(b"ACGT") for _ in range(200)) + text[20:90]
    exp, i = [], 0
    while i < len(data):
        word = data[i : i + 8]
        if len(data) - i >= 16 and word not in keys:
            b = code(word)
            left, right = max((w for w in keys if code(w) < b), key=code, default=None), min((w for w in keys if code(w) > b), key=code, default=None)
            near = min((w for w in (left, right) if w), key=lambda w: ((code(w) ^ b).bit_length(), code(w)))
            p, n = order[near], (16 - (code(near) ^ b).bit_length()) // 2
        else:
            p, n = reference.longest(data, i)
        exp.append((i, p, n) if n > 1 else (i, data[i], 1))
        i += max(n, 1)
    rows = spark.createDataFrame([(0, bytearray(data))], "id long, data binary")
    got = parse.parse(rows, "id", "data", reference, mode="kmer_fast")
    assert [tuple(p) for p in got.first()["phrases"]] == exp
    assert bytes(parse.decoded(got, "id", reference).first()["data"]) == data


def test_reports(spark, tmp_path):
    reference = parse.Reference(b"banana$")
    rows = spark.createDataFrame([(0, "ananab"), (1, "ananab"), (2, "nan")], "id long, text string")
    log = parse.refinements(rows, "id", "text", reference)
    files = {r["id"]: r for r in report.file_cache(log, 4).collect()}
    assert (files[0]["hits"], files[0]["misses"], files[0]["entries"]) == (0, 5, 5) and files[1]["hits"] == 5
    assert sum(r["hits"] for r in files.values()) == parse.cache_stats(log, 7, 4).first()["hits"] and files[2]["entries"] == parse.cache_stats(log, 7, 4).first()["entries"]
    assert {r["divisor"]: r["entries"] for r in parse.cache_sweep(log, 7, [1, 4]).collect()} == {1: files[2]["entries"], 4: files[2]["entries"]}
    parsed = parse.parse(rows, "id", "text", reference)
    equal = report.same_phrases(parsed, parsed, "id")
    assert report.totals(equal.join(parse.phrase_stats(parsed, "id"), "id"), ["n_bytes"]).first().asDict() == {"files": 3, "total_n_bytes": 15, "all_outputs_equal": True}
    assert not report.same_phrases(parsed, parsed.filter("id > 0"), "id").filter("id = 0").first()["outputs_equal"]
    report.write_csv(rows.selectExpr("id", "concat(text, ', \"') as t"), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).count() == 3
    assert report.speedup(4, 2) == 2 and report.speedup(1, 0) == 0 and report.timed_ms(rows) > 0
    assert parse.longest_cluster([(0, 6, 0, 97), (0, 6, 0, 110)], 128) >= 1 and parse.longest_cluster([], 7) == 0


def test_cached_and_seeded_parses_are_the_exact_one(spark):
    rng = random.Random(7)
    dna = lambda n: bytes(rng.choice(b"ACGT") for _ in range(n))
    for text in (dna(3000) * 2 + dna(50), b"ACGT" * 40, b"A" * 60, b"ACGTA", b"G"):
        reference = parse.Reference(text)
        table, known = reference.kmer_table(), {}
        keys = {text[p : p + 16] for p in range(len(text) - 15)}
        assert len(table[0]) == len(keys)
        for _ in range(15):
            cut = [text[p : p + rng.randint(0, 300)] for p in (rng.randrange(len(text)) for _ in range(rng.randint(0, 5)))]
            data = b"".join(x + dna(rng.choice([0, 1, 20])) for x in cut)
            want = reference.parse(data)
            assert reference.parse_seeded(data, table) == want and reference.parse_cached(data, known) == want
    rows = spark.createDataFrame([(1, bytearray(dna(200))), (2, None), (3, bytearray(b""))], "id long, data binary")
    for mode in ("exact", "cached", "kmer_seeded"):
        assert {r["id"]: len(r["phrases"]) > 0 for r in parse.parse(rows, "id", "data", parse.Reference(b""), mode).collect()} == {1: True, 2: False, 3: False}


def test_seeded_parse_is_fast_over_runs_and_compared_in_one_pass(spark, monkeypatch):
    """A run of one symbol is in many suffixes: refined symbol by symbol it took time by its length for each phrase."""
    steps = []
    refine = parse.Reference.refine
    monkeypatch.setattr(parse.Reference, "refine", lambda self, *asked: steps.append(asked) or refine(self, *asked))
    reference = parse.Reference(b"A" * 3000 + b"C" + b"A" * 2000 + b"G" + b"A" * 100 + b"T" * 8)
    data = b"A" * 2500 + b"T" + b"A" * 1999 + b"GA"
    assert reference.parse_seeded(data, reference.kmer_table()) == reference.parse(data) and len(steps) < 100
    rows = spark.createDataFrame([(1, bytearray(data)), (2, None), (None, bytearray(b"T" * 8 + b"C" * 64))], "id long, data binary")
    for mode, last in (("kmer_seeded", True), ("cached", True), ("kmer_fast", False)):
        found = parse.compared(rows, "id", "data", reference, mode)
        assert sorted((r["id"] or 0, r["n_bytes"], r["outputs_equal"]) for r in found.collect()) == [(0, 72, last), (1, len(data), True), (2, 0, True)]
    plan = sequences.kmer_parse_totals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_run_rows_and_summaries(spark):
    names = "file string, input_bytes long, baseline_ms double, pt16_ms double, baseline_phrases long, pt16_phrases long, outputs_equal boolean, pt16_hits long, pt16_misses long, singleton_hits long, range_hits long, pt16_entries long, approx_bytes long"
    rows = spark.createDataFrame([("a", 10, 4.0, 2.0, 3, 3, True, 3, 1, 1, 2, 7, 1 << 20), ("b", 5, 1.0, 0.0, 2, 2, False, 0, 0, 0, 0, 7, 1 << 20)], names)
    run = report.seeded_run(rows)
    assert run.columns == report.SEEDED_RUN
    a, b = report.as_text(run).orderBy("file").collect()
    assert list(a) == ["a", "10", "4.000", "2.000", "2.000", "3", "3", "YES", "3", "1", "0.750000", "1", "2", "0.333333", "7", "1.000", None]
    assert (b["speedup"], b["outputs_equal"], b["pt16_hit_rate"], b["singleton_hit_rate"]) == ("0.000", "NO", "0.000000", "0.000000")
    found = {r["metric"]: r["value"] for r in report.seeded_summary(run, 1.5).collect()}
    assert list(found) == report.SEEDED_SUMMARY
    assert (found["processed_files"], found["overall_speedup"], found["all_outputs_equal"], found["pt16_build_ms"], found["pt16_MB"]) == ("2", "2.500", "NO", "1.500000", "1.000")
    names = "file string, input_bytes long, rlz_ms double, phrases long, file_cache_hits long, file_cache_misses long, total_cache_entries long, table_slots long, max_probe_cluster long, approx_bytes long, peak_RSS_MB double"
    run = report.probing_run(spark.createDataFrame([("a", 10, 4.0, 3, 1, 3, 5, 16, 2, 1 << 19, 9.0), ("b", 5, 1.0, 2, 4, 0, 8, 16, 3, 1 << 20, report.peak_rss_mb())], names))
    assert run.columns == report.PROBING_RUN
    assert [r["load_factor"] for r in report.as_text(run).orderBy("file").collect()] == ["0.312500", "0.500000"]
    found = {r["metric"]: r["value"] for r in report.probing_summary(run, 1).collect()}
    assert list(found) == report.PROBING_SUMMARY
    assert (found["skipped_files"], found["avg_rlz_ms"], found["final_cache_hit_rate"], found["final_max_probe_cluster"], found["final_cache_MB"]) == ("1", "2.500", "0.625000", "3", "1.000")
    assert report.probing_summary(run.filter("false")).filter("metric = 'avg_rlz_ms'").first()["value"] == "0.000"


def test_cleaned_files_and_limits(spark):
    rows = spark.createDataFrame([("in/x", ">h\nAC\x00 gT"), ("in/y", None)], "path string, text string")
    x, y = report.cleaned_files(rows, "path", "text", "out").orderBy("input_file").collect()
    assert list(x) == ["in/x", "out/x", "ACAT", 4, 1, 1, 1, 1] and list(y) == ["in/y", "out/y", "", 0, 0, 0, 0, 0]
    metrics = report.cleaning_metrics(rows.filter("path = 'in/x'"), "text").collect()
    assert [tuple(r) for r in metrics][:2] == [("sequence_length", 4), ("replacement_count", 1)] and len(metrics) == 5
    assert [tuple(r) for r in report.limited(rows, "path", "text", 1, 3).collect()] == [("in/x", ">h\n")]
    assert report.limited(rows, "path", "text", 5).count() == 2


def test_refinements_counted_where_they_are_found(spark):
    """The same as from the refinements themselves, with a row a refinement and not one for each time that it is asked for."""
    reference = parse.Reference(b"banana$bandana$")
    rows = spark.createDataFrame([(k, "ananab" * (k + 1) + "dan" * (k % 3)) for k in range(40)] + [(40, "")], "id long, text string").repartition(3)
    log, counts = parse.refinements(rows, "id", "text", reference), parse.refinement_counts(rows, "id", "text", reference)
    assert counts.count() < log.count() / 10
    for made in (lambda x: parse.cache_sweep(x, 15, [1, 4]), lambda x: report.file_cache(x, 4)):
        assert sorted(made(counts).collect()) == sorted(made(log).collect())
    assert sorted(parse.bucket_traces(rows, "id", "text", reference, 4).collect()) == sorted(parse.bucket_trace(log, 4).collect())
