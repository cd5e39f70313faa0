"""Queries over texts: the benchmark table's texts in their order are the reference, the documents are parsed."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.cleaning import clean_sequence, cleaning_counters
from skein.operators import access, kmers, parse, report, suffix
from skein.session import checkpointed, stored, tables_dir, tasks_for
from skein.sources import files

#: Bytes of a file (compressed) whose texts are one task's.
DEALT_BYTES = 1 << 20

CACHE_DIVISOR, HIT_LENGTHS, ASKED, SPAN = 32, [4, 8, 12, 16], 10, 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reference(spark: SparkSession, sf_dir: str) -> parse.Reference:
    return parse.reference_of(_table(spark, sf_dir, "benchmark"), "text", "item_id")


def _dealt(rows: DataFrame, id: str) -> DataFrame:
    """Dealt out evenly: what follows costs far more than moving the texts, and a small file is read by few tasks. As many parts as the bytes ask for."""
    return rows.repartition(tasks_for(rows, DEALT_BYTES), id)


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, parse.Reference]:
    reference = _reference(spark, sf_dir)
    docs = _dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return parse.parse(docs, "doc_id", F.encode("text", "UTF-8"), reference), reference


def _clean_reference(spark: SparkSession, sf_dir: str) -> parse.Reference:
    rows = _table(spark, sf_dir, "benchmark").select("item_id", clean_sequence(F.col("text")).alias("text"))
    return parse.reference_of(rows, "text", "item_id")


def _suffixes(spark: SparkSession, reference: parse.Reference) -> DataFrame:
    """Of a reference that may be broadcast, handed over as Arrow columns."""
    return spark.createDataFrame(pa.table({"sa_idx": np.arange(len(reference.sa)), "pos": reference.sa}))


def suffix_array(spark, sf_dir):
    return _suffixes(spark, _reference(spark, sf_dir))


def suffix_array_distributed(spark, sf_dir):
    """The same from a table of symbols, by joins and sorts alone."""
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.hex(F.encode("text", "UTF-8")).alias("h"))
    before = F.coalesce(F.sum(F.length("h") / 2).over(Window.orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # the rows of a reference are few
    parts = rows.withColumn("first", before.cast("long")).select("first", "h", F.explode(F.sequence(F.lit(0), (F.length("h") / 2 - 1).cast("int"))).alias("k"))
    symbols = parts.select((F.col("first") + F.col("k")).alias("pos"), F.conv(F.substring("h", 2 * F.col("k") + 1, F.lit(2)), 16, 10).cast("int").alias("symbol"))
    return suffix.suffix_array_table(symbols)


def lz_parse(spark, sf_dir):
    return parse.phrase_rows(_parsed(spark, sf_dir)[0], "doc_id")


def lz_stats(spark, sf_dir):
    return parse.phrase_stats(_parsed(spark, sf_dir)[0], "doc_id")


def lz_tiling(spark, sf_dir):
    rows = parse.phrase_rows(_parsed(spark, sf_dir)[0], "doc_id")
    return rows.groupBy("doc_id").agg(F.sum("len").alias("n_bytes"), F.max(F.col("start") + F.col("len")).alias("last_end"))


def lz_roundtrip(spark, sf_dir):
    parsed, reference = _parsed(spark, sf_dir)
    return parse.decoded(parsed, "doc_id", reference).select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("md5"))


def lz_coverage(spark, sf_dir):
    parsed, reference = _parsed(spark, sf_dir)
    return parse.coverage(parsed, "doc_id", len(reference.text))


def lz_hit_rates(spark, sf_dir):
    return parse.predicted_hits(_parsed(spark, sf_dir)[0], "doc_id", HIT_LENGTHS)


def _asked(docs: DataFrame) -> DataFrame:
    """Ten places of each document with any bytes, by a linear rule on its id."""
    n = F.octet_length(F.encode("text", "UTF-8")).cast("long")
    rows = docs.select("doc_id", n.alias("n_bytes"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ASKED - 1).cast("long"))).alias("k")).filter("n_bytes > 0")
    return rows.select("doc_id", "k", "n_bytes", ((F.col("k") * 1103515245 + F.col("doc_id") * 7919 + 12345) % F.col("n_bytes")).alias("p"))


def lz_access(spark, sf_dir):
    parsed, reference = _parsed(spark, sf_dir)
    positions = _asked(_table(spark, sf_dir, "documents")).select("doc_id", "k", "p")
    return access.access(parse.phrase_rows(parsed, "doc_id"), positions, "doc_id", reference).select("doc_id", "k", "p", "symbol")


def lz_extract(spark, sf_dir):
    parsed, reference = _parsed(spark, sf_dir)
    ranges = _asked(_table(spark, sf_dir, "documents")).select("doc_id", "k", "p", F.least(F.lit(SPAN).cast("long"), F.col("n_bytes") - F.col("p")).alias("n"))
    return access.extracts(parse.phrase_rows(parsed, "doc_id"), ranges, "doc_id", reference).select("doc_id", "k", "p", "n", F.hex("data").alias("data"))


def _asked_of_cache(spark, sf_dir):
    return _dealt(_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.encode("text", "UTF-8").alias("data")), _reference(spark, sf_dir)


def _counts(spark, sf_dir):
    docs, reference = _asked_of_cache(spark, sf_dir)
    return stored(parse.refinement_counts(docs, "doc_id", "data", reference), "refinements"), reference


def cache_stats(spark, sf_dir):
    counts, reference = _counts(spark, sf_dir)
    return parse.cache_stats(counts, len(reference.text), CACHE_DIVISOR)


def bucket_trace(spark, sf_dir):
    docs, reference = _asked_of_cache(spark, sf_dir)
    return parse.bucket_traces(docs, "doc_id", "data", reference, CACHE_DIVISOR)


def cache_sweep(spark, sf_dir):
    counts, reference = _counts(spark, sf_dir)
    return parse.cache_sweep(counts, len(reference.text), [8 << k for k in range(10)])


def cache_by_file(spark, sf_dir):
    return report.file_cache(_counts(spark, sf_dir)[0], CACHE_DIVISOR)


def _compared(rows: DataFrame, data: str | Column, reference: parse.Reference, mode: str) -> DataFrame:
    return report.totals(parse.compared(rows, "doc_id", data, reference, mode), ["n_bytes"])


def lz_totals(spark, sf_dir):
    """The parse of all documents that keeps its refinements, against the plain one, phrase by phrase."""
    docs = _dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return _compared(docs, F.encode("text", "UTF-8"), _reference(spark, sf_dir), "cached")


def _cleaned_docs(spark, sf_dir):
    rows = _dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", clean_sequence(F.col("text")).alias("text"))


def kmer_parse_totals(spark, sf_dir):
    """The parse that starts from the reference's 16-mers against the plain one, phrase by phrase."""
    return _compared(_cleaned_docs(spark, sf_dir), "text", _clean_reference(spark, sf_dir), "kmer_seeded")


def kmer_parse(spark, sf_dir):
    return parse.phrase_rows(parse.parse(_cleaned_docs(spark, sf_dir), "doc_id", "text", _clean_reference(spark, sf_dir), mode="kmer_seeded"), "doc_id")


def _file(spark, name: str) -> str:
    return f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kmer_table_file(spark, sf_dir):
    """The k-mer table written as one binary file and read again."""
    index, path = checkpointed(kmer_index(spark, sf_dir)), _file(spark, "kmers")
    files.write_kmer_table(spark, path, index, kmers.bucket_directory(index))
    return files.read_kmer_table(spark, path)


def suffix_array_file(spark, sf_dir):
    """The suffix array written as 32-bit numbers and read again, with the check that it is as long as the reference."""
    reference, path = _reference(spark, sf_dir), _file(spark, "suffixes")
    files.write_bytes(spark, path, files.joined_bytes(files.number_bytes(_suffixes(spark, reference), "sa_idx", "pos", 4), "sa_idx"))
    return files.read_suffix_array(spark, path, length=len(reference.text))


def sequence_files(spark, sf_dir):
    """Each benchmark text as a file of bytes, read again whole."""
    path = _file(spark, "sequences")
    for row in _table(spark, sf_dir, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("data")).toLocalIterator():  # a reference's parts
        files.write_bytes(spark, f"{path}/{row['item_id']}", [bytes(row["data"] or b"")])
    name = F.element_at(F.split("path", "/"), -1).cast("long").alias("item_id")
    return files.read_sequences(spark, path).select(name, F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("md5"))


def phrase_files(spark, sf_dir):
    """The phrases of each document as 64-bit words behind their number: bytes and number of phrases, and what they decode to by length."""
    parsed, _ = _parsed(spark, sf_dir)
    data = files.phrase_bytes(parse.phrase_rows(parsed, "doc_id"), "doc_id")
    n = (F.octet_length("data") - 8) / 24
    ends = parsed.select("doc_id", F.size("phrases").alias("n"), "n_bytes")
    return data.join(ends, "doc_id").select("doc_id", "n_bytes", (n == F.col("n")).alias("fits"))


def kmer_fast_parse(spark, sf_dir):
    """Documents parsed with the short factors of empty buckets, and how many phrases that makes."""
    reference = _clean_reference(spark, sf_dir)
    texts = _dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", clean_sequence(F.col("text")).alias("text"))
    return parse.phrase_stats(parse.parse(texts, "doc_id", "text", reference, mode="kmer_fast"), "doc_id")


def clean_documents(spark, sf_dir):
    cleaned = clean_sequence(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(cleaned).cast("long").alias("sequence_length"), F.md5(cleaned.cast("binary")).alias("md5"))


def clean_pages(spark, sf_dir):
    cleaned = clean_sequence(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(cleaned.cast("binary")).alias("md5"), *[c.cast("long").alias(k) for k, c in cleaning_counters(F.col("html")).items()])


def clean_totals(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(*[c.cast("long").alias(k) for k, c in cleaning_counters(F.col("text")).items()])
    return rows.agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in rows.columns])


def cleaned_files(spark, sf_dir):
    """The pages as input files: where each one's cleaned sequence goes, and what cleaning did."""
    rows = report.cleaned_files(_table(spark, sf_dir, "pages").withColumn("path", F.concat(F.lit("in/"), F.col("page_id").cast("string"))), "path", "html", "cleaned/")
    return rows.withColumn("data", F.md5(F.col("data").cast("binary"))).withColumnRenamed("data", "md5")


def cleaning_metrics(spark, sf_dir):
    """Of the reference: its texts in their order as one."""
    parts = F.sort_array(F.collect_list(F.struct("item_id", F.coalesce("text", F.lit("")).alias("text"))))  # a reference's parts
    return report.cleaning_metrics(_table(spark, sf_dir, "benchmark").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text")), "text")


def limited_files(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return report.limited(rows, "doc_id", "data", 20, 100).select("doc_id", F.hex("data").alias("data"))


def kmer_index(spark, sf_dir):
    reference = _clean_reference(spark, sf_dir)
    return kmers.kmer_index(_suffixes(spark, reference), reference.text.decode())


def kmer_buckets(spark, sf_dir):
    return kmers.bucket_directory(kmer_index(spark, sf_dir))


def kmer_counts(spark, sf_dir):
    rows = _dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", clean_sequence(F.col("text")).alias("text"))
    found = kmers.kmers(rows, "doc_id", "text").groupBy("kmer").agg(F.count(F.lit(1)).alias("occurrences"))
    return found.select(kmers.pack_kmer(F.col("kmer")).alias("key"), "occurrences")


def _seeds(spark, sf_dir):
    reference = _clean_reference(spark, sf_dir)
    texts = _dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", clean_sequence(F.col("text")).alias("text"))
    suffixes = _suffixes(spark, reference)
    index = kmers.kmer_index(suffixes, reference.text.decode())
    phrases = parse.phrase_rows(parse.parse(texts, "doc_id", "text", reference), "doc_id")
    return kmers.seeded(phrases, texts, index, "doc_id"), index, suffixes


def kmer_hit_rate(spark, sf_dir):
    seeds, index, _ = _seeds(spark, sf_dir)
    return kmers.seed_stats(seeds, index, "doc_id")


def kmer_fast_factors(spark, sf_dir):
    """The factors that empty buckets would give, by length."""
    seeds, index, suffixes = _seeds(spark, sf_dir)
    rows = kmers.fast_factors(seeds, kmers.bucket_directory(index), index, suffixes).filter("fast_len is not null")
    return rows.groupBy("fast_len").agg(F.count(F.lit(1)).alias("factors"), F.count_if(F.col("fast_len") == F.col("len")).alias("as_long"))


QUERIES = {
    f.__name__: f
    for f in (
        suffix_array, suffix_array_distributed, lz_parse, lz_stats, lz_tiling, lz_roundtrip, lz_coverage, lz_hit_rates, lz_access, lz_extract, cache_stats, bucket_trace, cache_sweep, cache_by_file, lz_totals, kmer_fast_parse,
        kmer_parse, kmer_parse_totals, kmer_table_file, suffix_array_file, sequence_files, phrase_files,
        clean_documents, clean_pages, clean_totals, cleaned_files, cleaning_metrics, limited_files, kmer_index, kmer_buckets, kmer_counts, kmer_hit_rate, kmer_fast_factors,
    )
}

_REFERENCE = "ref AS (SELECT hex(encode(string_agg(text, '' ORDER BY item_id))) AS h FROM benchmark)"
_SUFFIXES = f"""
WITH {_REFERENCE},
places AS (SELECT h, unnest(range(length(h) // 2)) AS pos FROM ref)
SELECT row_number() OVER (ORDER BY substr(h, 2 * pos + 1)) - 1 AS sa_idx, pos FROM places
"""
_ASKED = """
asked AS (
  SELECT doc_id, k, strlen(text)::BIGINT AS n_bytes, (k * 1103515245 + doc_id * 7919 + 12345) % strlen(text)::BIGINT AS p, hex(encode(text)) AS h
  FROM (SELECT doc_id, text, unnest(range(10)) AS k FROM documents WHERE strlen(text) > 0))"""


def _cleaned(column: str) -> str:
    bare = f"replace(coalesce({column}, ''), chr(0), '')"
    rest = rf"regexp_replace({bare}, '((?:^|[\n\r])[ \t\v\f]*)>[^\n\r]*', '\1', 'g')"
    symbols = rf"regexp_replace({rest}, '[ \t\n\v\f\r]', '', 'g')"
    for low, high, n in ("0080", "07FF", 2), ("0800", "FFFF", 3), ("10000", "10FFFF", 4):
        symbols = rf"regexp_replace({symbols}, '[\x{{{low}}}-\x{{{high}}}]', '{'#' * n}', 'g')"
    return f"regexp_replace({symbols}, '[^ACGT]', 'A', 'g')"


def _counters(column: str) -> str:
    bare = f"replace(coalesce({column}, ''), chr(0), '')"
    header = r"((?:^|[\n\r])[ \t\v\f]*)>[^\n\r]*"
    rest = rf"regexp_replace({bare}, '{header}', '\1', 'g')"
    cleaned = rf"regexp_replace({rest}, '[ \t\n\v\f\r]', '', 'g')"
    return rf"""strlen({cleaned})::BIGINT AS sequence_length,
       strlen(regexp_replace({cleaned}, '[ACGT]', '', 'g'))::BIGINT AS replacement_count,
       len(regexp_extract_all({bare}, '{header}'))::BIGINT AS header_lines_removed,
       (strlen({rest}) - strlen({cleaned}) - len(regexp_extract_all({bare}, '{header}'))
         + CASE WHEN regexp_matches({bare}, '(?:^|[\n\r])[ \t\v\f]*>[^\n\r]*$') THEN 1 ELSE 0 END)::BIGINT AS whitespace_characters_removed,
       (strlen(coalesce({column}, '')) - strlen({bare}))::BIGINT AS nul_bytes_removed"""


_PACK = "('0b' || replace(replace(replace(replace({}, 'A', '00'), 'C', '01'), 'G', '10'), 'T', '11'))::BIGINT"
_INDEX = f"""
cleaned AS (SELECT string_agg({_cleaned("text")}, '' ORDER BY item_id) AS t FROM benchmark),
places AS (SELECT t, unnest(range(length(t))) AS pos FROM cleaned),
suffixes AS (SELECT row_number() OVER (ORDER BY substr(t, pos + 1)) - 1 AS sa_idx, pos, substr(t, pos + 1, 16) AS kmer FROM places),
idx AS (SELECT {_PACK.format("kmer")} AS key, min(sa_idx) AS sa_start, max(sa_idx) AS sa_end FROM suffixes WHERE length(kmer) = 16 GROUP BY kmer)"""

ORACLE_SQL = {
    "suffix_array": _SUFFIXES,
    "suffix_array_distributed": _SUFFIXES,
    "lz_tiling": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, strlen(text)::BIGINT AS last_end FROM documents WHERE strlen(text) > 0",
    "lz_roundtrip": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS md5 FROM documents",
    "lz_access": f"WITH {_ASKED} SELECT doc_id, k, p, ('0x' || substr(h, 2 * p + 1, 2))::BIGINT AS symbol FROM asked",
    "lz_extract": f"WITH {_ASKED} SELECT doc_id, k, p, least(100, n_bytes - p) AS n, substr(h, 2 * p + 1, 200) AS data FROM asked",
    "clean_documents": f"SELECT doc_id, length({_cleaned('text')})::BIGINT AS sequence_length, md5({_cleaned('text')}) AS md5 FROM documents",
    "clean_pages": f"SELECT page_id, md5({_cleaned('html')}) AS md5, {_counters('html')} FROM pages",
    "clean_totals": f"WITH c AS (SELECT {_counters('text')} FROM documents) SELECT count(*) AS files, sum(sequence_length)::BIGINT AS sequence_length, sum(replacement_count)::BIGINT AS replacement_count, sum(header_lines_removed)::BIGINT AS header_lines_removed, sum(whitespace_characters_removed)::BIGINT AS whitespace_characters_removed, sum(nul_bytes_removed)::BIGINT AS nul_bytes_removed FROM c",
    "cleaned_files": f"SELECT 'in/' || page_id AS input_file, 'cleaned/' || page_id AS cleaned_file, md5({_cleaned('html')}) AS md5, {_counters('html')} FROM pages",
    "cleaning_metrics": f"""
WITH whole AS (SELECT string_agg(coalesce(text, ''), '' ORDER BY item_id) AS text FROM benchmark), c AS (SELECT {_counters("text")} FROM whole)
UNPIVOT c ON sequence_length, replacement_count, header_lines_removed, whitespace_characters_removed, nul_bytes_removed INTO NAME metric VALUE value""",
    "limited_files": "SELECT doc_id, substr(hex(encode(text)), 1, 200) AS data FROM documents ORDER BY doc_id LIMIT 20",
    "lz_totals": "SELECT count(*) AS files, coalesce(sum(strlen(coalesce(text, ''))), 0)::BIGINT AS total_n_bytes, true AS all_outputs_equal FROM documents",
    "kmer_parse_totals": f"SELECT count(*) AS files, coalesce(sum(length({_cleaned('text')})), 0)::BIGINT AS total_n_bytes, true AS all_outputs_equal FROM documents",
    "kmer_table_file": f"WITH {_INDEX} SELECT key >> 16 AS bucket, key & 65535 AS low, key, sa_start FROM idx",
    "suffix_array_file": _SUFFIXES,
    "sequence_files": "SELECT item_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS md5 FROM benchmark",
    "phrase_files": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, true AS fits FROM documents WHERE strlen(text) > 0",
    "kmer_index": f"WITH {_INDEX} SELECT key, key >> 16 AS bucket, key & 65535 AS low, sa_start, sa_end FROM idx",
    "kmer_buckets": f"""
WITH {_INDEX},
counted AS (SELECT s.bucket, coalesce(c.entries, 0) AS entries FROM (SELECT unnest(range(65536)) AS bucket) s LEFT JOIN (SELECT key >> 16 AS bucket, count(*) AS entries FROM idx GROUP BY 1) c USING (bucket)),
near AS (
  SELECT bucket, entries, coalesce(sum(entries) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_entry,
         max(CASE WHEN entries > 0 THEN bucket END) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
         min(CASE WHEN entries > 0 THEN bucket END) OVER (ORDER BY bucket ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r
  FROM counted)
SELECT bucket, entries, first_entry,
       CASE WHEN entries > 0 THEN -1 WHEN l IS NULL THEN r WHEN r IS NULL THEN l WHEN length(bin(xor(bucket, l))) <= length(bin(xor(bucket, r))) THEN l ELSE r END AS nearest
FROM near""",
    "kmer_counts": f"""
WITH c AS (SELECT {_cleaned("text")} AS t FROM documents),
k AS (SELECT substr(t, p + 1, 16) AS kmer FROM (SELECT t, unnest(range(length(t) - 15)) AS p FROM c WHERE length(t) >= 16))
SELECT {_PACK.format("kmer")} AS key, count(*) AS occurrences FROM k GROUP BY kmer""",
}
