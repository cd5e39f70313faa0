"""Line dedup by a deletion-neighbourhood join (DataFrame functions only).

Lines are compared as sequences of words. Each line emits the hashes of all sequences that one deletion makes of it, and of itself;
lines that share one are within one edit if the deletions are at the same place, or one of them deletes nothing. What is so found
is verified on the words. Before that, lines that share neither of their halves with another can't be within one edit of any:
they emit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import NULL_ID, SPACES, documents, normalised, whole_text, word_count, written
from skein.llm.keyfilter import key_filter, with_maybe
from skein.session import drop_table

#: Lines of fewer words are compared for equality only: one edit would be too large a part of them.
FEWEST_WORDS = 8

#: A line's place, and what orders lines: document, then the hash of its text should ids repeat, then the line's number.
PLACE = ["did", "content", "no"]


def _keyed(docs: DataFrame, text: str, id: str) -> DataFrame:
    """docs and its rows' did, content and whole, which take the place of columns with these names."""
    return docs.withColumns({"did": F.coalesce(F.col(id).cast("long"), F.lit(NULL_ID)), "content": F.xxhash64(whole_text(text)), "whole": whole_text(text)})


def _half(norm: Column, kind: str, count: Column) -> Column:
    """The hash of so many first (kind p) or last (kind s) words."""
    return F.xxhash64(F.lit(kind), count, F.call_function("substring_index", norm, F.lit(" "), (count if kind == "p" else -count).cast("int")))


def all_lines(keyed: DataFrame) -> DataFrame:
    """Each line that has a word: its place, hash, hash2, n (words) and the hashes of its halves.

    Of two lines within one edit, with m words the shorter, either the first ceil(m/2) words of both are equal, or the last
    m - ceil(m/2): the edit lies behind the ones or before the others. A line may be the shorter, or the longer by one.
    """
    norm, n = F.col("norm"), F.col("n")
    lines = (
        keyed.select("did", "content", F.posexplode(F.split(normalised(F.col("whole")), "\n")).alias("no", "line"))
        .select("did", "content", "no", F.btrim("line").alias("norm"))
        .filter("norm != ''")
        .withColumn("n", word_count(norm))
    )
    up, down, longer = ((n + 1) / 2).cast("int"), (n / 2).cast("int"), ((n - 1) / 2).cast("int")
    halves = {"p1": _half(norm, "p", up), "p2": _half(norm, "p", down), "s1": _half(norm, "s", n - up), "s2": _half(norm, "s", longer)}
    return lines.select(*PLACE, "n", F.xxhash64("norm").alias("hash"), F.hash("norm").alias("hash2"), *[c.alias(k) for k, c in halves.items()])


def _text_of(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """places (did, content, no) with norm, the normalised line. Documents without any of them aren't shuffled."""
    by_document = places.groupBy("did", "content").agg(F.collect_set("no").alias("nos"))
    some = with_maybe(keyed.select("did", "content", "whole"), ["did", "content"], key_filter(places.select("did", "content").distinct(), ["did", "content"]))
    found = some.filter("_maybe").join(by_document, ["did", "content"]).withColumn("lines", F.split(normalised(F.col("whole")), "\n"))
    return found.select("did", "content", "lines", F.explode("nos").alias("no")).select(*PLACE, F.btrim(F.get("lines", F.col("no"))).alias("norm"))


def variants(lines: DataFrame) -> DataFrame:
    """lines: rank, norm. Rows rank, key, length, gone: the word that was deleted, counted from 1, or 0 for the line itself.

    A key is the exclusive or of hashes of (word, its place in the sequence), so that running ones give all of a line's keys.
    """
    line = Window.partitionBy("rank")
    order = line.orderBy("at")
    words = lines.select("rank", F.posexplode(F.split("norm", " ")).alias("at", "word"))
    words = words.select("rank", (F.col("at") + 1).alias("at"), F.xxhash64("word", F.col("at") + 1).alias("here"), F.xxhash64("word", F.col("at")).alias("moved"))
    zero = F.lit(0).cast("long")
    rows = words.select(
        "rank",
        "at",
        F.count(F.lit(1)).over(line).cast("int").alias("n"),
        F.coalesce(F.bit_xor("here").over(order.rowsBetween(Window.unboundedPreceding, -1)), zero).alias("before"),
        F.bit_xor("here").over(line).alias("whole"),
        F.bit_xor("moved").over(line).alias("whole_moved"),
        F.bit_xor("moved").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("until_moved"),
    )
    after = F.col("whole_moved").bitwiseXOR(F.col("until_moved"))
    one = F.struct(F.col("before").bitwiseXOR(after).alias("key"), (F.col("n") - 1).alias("length"), F.col("at").alias("gone"))
    itself = F.struct(F.col("whole").alias("key"), F.col("n").alias("length"), F.lit(0).alias("gone"))
    return rows.select("rank", F.explode(F.when(F.col("at") == 1, F.array(itself, one)).otherwise(F.array(one))).alias("v")).select("rank", "v.*")


def within_one_edit(one: str, two: str) -> Column:
    """Whether two sequences of words differ by at most one inserted, deleted or replaced word."""
    a, b = F.split(one, " "), F.split(two, " ")

    def same(x: Column, y: Column) -> Column:
        least = F.least(F.size(x), F.size(y))
        at = F.array_position(F.zip_with(F.slice(x, F.lit(1), least), F.slice(y, F.lit(1), least), lambda p, q: p == q), False)
        return F.when(at == 0, least).otherwise(at - 1)

    most = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (same(a, b) + same(F.reverse(a), F.reverse(b)) >= most - 1)


def near_lines(keyed: DataFrame, distinct: DataFrame, fewest_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """Places of distinct lines that have an earlier distinct line within one edit, and the tables that these rows are read from."""
    long = distinct.filter(F.col("n") >= fewest_words)
    halves = long.select(*PLACE, F.explode(F.array_distinct(F.array("p1", "p2", "s1", "s2"))).alias("half"))
    shared = written(halves.groupBy("half").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("half"), "halves")
    some = with_maybe(halves, ["half"], key_filter(shared, ["half"])).filter("_maybe")
    candidates = written(some.join(shared, "half", "left_semi").select(*PLACE).distinct(), "candidates")
    drop_table(shared)
    # In the order of their places, so that a rank is a place in one number.
    lines = _text_of(keyed, candidates).distinct().orderBy(*PLACE).withColumn("rank", F.monotonically_increasing_id())
    lines = written(lines, "candidate-lines")
    drop_table(candidates)
    emitted = written(variants(lines.select("rank", "norm")), "variants")
    whole = F.when(F.col("gone") == 0, F.col("rank"))
    met = emitted.groupBy("key", "length").agg(F.min("rank").alias("least"), F.min(whole).alias("least_whole"), F.max("rank").alias("most")).filter("least != most").drop("most")
    met = written(met, "met")
    some = with_maybe(emitted, ["key", "length"], key_filter(met, ["key", "length"])).filter("_maybe").drop("_maybe").join(met, ["key", "length"])
    same = written(some.groupBy("key", "length", "gone").agg(F.min("rank").alias("least_same")), "met-same")
    some = some.join(same, ["key", "length", "gone"])
    earlier = F.when(F.col("gone") == 0, F.col("least")).otherwise(F.least("least_whole", "least_same"))
    pairs = some.select("rank", earlier.alias("earlier")).filter("earlier < rank").groupBy("rank").agg(F.min("earlier").alias("earlier"))
    other = lines.select(F.col("rank").alias("earlier"), F.col("norm").alias("earlier_norm"))
    return pairs.join(lines, "rank").join(other, "earlier").filter(within_one_edit("norm", "earlier_norm")).select(*PLACE), [lines, emitted, met, same]


def dedup_lines(docs: DataFrame, text: str = "text", id: str = "doc_id", fewest_words: int = FEWEST_WORDS) -> DataFrame:
    """docs with the text's repeated lines taken out, and the columns n_lines, n_exact, n_near (long; these names are replaced).

    Lines are equal if their words are, in lower case. A line goes if an earlier one (smaller id, or further up) is equal to it
    (n_exact), or, for lines of fewest_words or more, if the first of its equals has an earlier line within one inserted, deleted
    or replaced word (n_near), whether or not that one goes too. Lines without a word stay. Null texts stay null. A null id
    orders before all others. Rows that repeat an id and its text are one document and keep the same lines; ids that repeat
    with other texts are ordered by a hash of the text. An empty table gives no rows.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_exact", "n_near")])
    keyed = _keyed(docs.select(id, text), text, id)
    lines = written(all_lines(keyed), "lines")
    place = F.struct(*PLACE, "p1", "p2", "s1", "s2")
    distinct = lines.groupBy("hash", "hash2", "n").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"))
    distinct = written(distinct.select("hash", "hash2", "n", "copies", "first.*"), "distinct-lines")
    several = distinct.filter("copies > 1").select("hash", "hash2", "n", F.struct(*PLACE).alias("first"))
    equal = with_maybe(lines.select(*PLACE, "hash", "hash2", "n"), ["hash"], key_filter(several, ["hash"])).filter("_maybe")
    exact = equal.join(several, ["hash", "hash2", "n"]).filter("struct(did, content, no) != first").select(*PLACE)
    near, read = near_lines(keyed, distinct, fewest_words)
    both = exact.withColumn("near", F.lit(False)).unionByName(near.withColumn("near", F.lit(True)))
    gone = both.groupBy("did", "content").agg(
        F.collect_set(F.when(~F.col("near"), F.col("no"))).alias("exact"), F.collect_set(F.when(F.col("near"), F.col("no"))).alias("near")
    )
    gone = written(gone, "gone-lines")
    for last in [lines, distinct, *read]:  # what follows reads gone alone
        drop_table(last)
    # The row is carried as one column, so that its names can't meet those used here.
    key = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id).cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(whole_text(text)).alias("content"))
    marked = with_maybe(key, ["did", "content"], key_filter(gone, ["did", "content"]))
    none = F.array().cast("array<int>")
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    touched = marked.filter("_maybe").join(gone, ["did", "content"], "left").withColumns({"exact": F.coalesce("exact", none), "near": F.coalesce("near", none)})
    touched = touched.withColumn("lines", F.split(whole, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.concat("exact", "near"))
    same = (F.size("exact") + F.size("near") == 0) | F.col("row")[text].isNull()
    rest = F.when(same, F.col("row")[text]).otherwise(F.array_join(F.transform(stay, lambda k: F.get("lines", k)), "\n"))

    def shown(rows: DataFrame, text_now: Column, exact: Column, near: Column) -> DataFrame:
        filled = F.size(F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
        counts = {"n_lines": filled, "n_exact": exact, "n_near": near}
        return rows.select(*[text_now.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns], *[c.cast("long").alias(k) for k, c in counts.items()])

    untouched = shown(marked.filter("not _maybe"), F.col("row")[text], F.lit(0), F.lit(0))
    return shown(touched, rest, F.size("exact"), F.size("near")).unionByName(untouched)


def op4(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(whole_text().cast("binary"), 256).alias("kept_sha256"))
