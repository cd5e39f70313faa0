"""Quality rules by the frequency of lines across documents (DataFrame functions only).

Normalised lines are hashed; a line's frequency in a host is the number of distinct documents there that have it. Lines above
the limit are taken away, and documents of which too little is left are rejected, besides those that fail the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SPACE_CLASS, SPACES, documents, length_without, normalised, whole_text, word_count, written
from skein.llm.keyfilter import key_filter, with_maybe
from skein.session import drop_table

#: Fixed values of the base rules: fewest words, and the largest share of repeated words in percent.
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A line is taken away if over MANY_DOCUMENTS distinct documents of its host, and over MANY_SHARE of them, have it.
MANY_DOCUMENTS, MANY_SHARE = 50, 0.001
#: Near copies share so many lines at least.
NEAR_SHARED = 3


def split_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def normalised_lines(text: Column) -> Column:
    """Structs (hash, words) of the lines that have a word: lower case, single spaces."""
    lines = F.filter(F.transform(F.split(normalised(text), "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("hash"), word_count(x).alias("words")))


def held() -> Column:
    """A number of the row that always holds: it keeps Spark from copying columns into filters and lambdas, one by one."""
    return F.monotonically_increasing_id() >= 0


def base_features(docs: DataFrame, text: str = "_text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; names that begin with _ are its own.

    All within a row: the 3-word windows of a document are hashed, sorted with their places if any two are equal, and the
    places of equal neighbours tell the words that they cover.
    """
    whole = whole_text(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = (
        docs.withColumn("_words", split_words(whole))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", length_without(whole, SPACES).cast("long"))
        .withColumn("n_symbols", (F.length(whole) - length_without(whole, SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    )
    windows = F.transform(
        F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    rows = rows.withColumn("_windows", windows)
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    rows = rows.withColumn("_placed", F.when(held() & repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    twice = F.filter(
        "_placed",
        lambda x, k: F.coalesce(F.get("_placed", k + 1)["h"] == x["h"], F.lit(False)) | ((k > 0) & F.coalesce(F.get("_placed", k - 1)["h"] == x["h"], F.lit(False))),
    )
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total"), p.alias("last")),
        lambda acc: acc["total"],
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("n_repeat_words", covered).withColumn("base_failed", failed).drop("_words", "_lines", "_windows", "_placed")


def hashed_lines(rows: DataFrame) -> DataFrame:
    """rows with a row for each of their lines: place, hash, words; and all_lines and all_words of their distinct lines."""
    named = [c for c in rows.columns if c != "_lines"]
    # What always holds keeps Spark from splitting and hashing each text once more, for a filter of its own below the one for the rows.
    rows = rows.withColumn("_lines", F.when(held(), F.col("_lines")))
    rows = rows.withColumn("all_lines", F.size(F.array_distinct(F.transform("_lines", lambda x: x["hash"]))))  # of structs, all pairs would be compared
    nothing = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("last"))

    def added(so_far: Column, x: Column) -> Column:
        again = F.coalesce(x["hash"] == so_far["last"], F.lit(False))
        return F.struct((so_far["total"] + F.when(again, 0).otherwise(x["words"])).alias("total"), x["hash"].alias("last"))

    once = F.aggregate("_lines", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    several = F.aggregate(F.sort_array("_lines"), nothing, added, lambda so_far: so_far["total"])
    rows = rows.withColumn("all_words", F.when(F.size("_lines") == F.col("all_lines"), once).otherwise(several))
    lines = rows.select(*named, "all_lines", "all_words", F.posexplode("_lines").alias("place", "line"))
    return lines.select(*named, "all_lines", "all_words", "place", "line.hash", "line.words")


def above(seen: DataFrame, docs: DataFrame, many_documents: int, many_share: float) -> DataFrame:
    """host, hash of seen's rows (_host, hash, document) above the limit. docs: _host, a row for each document."""
    counted = seen.distinct().groupBy("_host", "hash").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > many_documents)
    hosts = docs.groupBy(F.col("_host").alias("host")).agg(F.count(F.lit(1)).alias("all_documents"))
    return counted.join(hosts, counted["_host"].eqNullSafe(hosts["host"])).filter(F.col("documents") > many_share * F.col("all_documents")).select("host", "hash")


def common_lines(lines: DataFrame, docs: DataFrame, many_documents: int, many_share: float) -> DataFrame:
    """host, hash of the lines above the limit. docs: _host, a row for each document.

    Texts that are equal are one document. So are near copies, lest they reject one another: texts with the same NEAR_SHARED or
    more lines that many texts have, and besides these at most one line, of fewer than FEWEST_WORDS words. All others count,
    whatever lines they share.
    """
    many = written(above(lines.select("_host", "hash", F.col("_content").alias("document")), docs, many_documents, many_share), "many-lines")
    some = with_maybe(lines, ["hash"], key_filter(many, ["hash"])).filter("_maybe").drop("_maybe")
    some = some.join(many.withColumnRenamed("hash", "many_hash"), some["_host"].eqNullSafe(F.col("host")) & (some["hash"] == F.col("many_hash")))
    some = some.select("_host", "_content", "all_lines", "all_words", "hash", "words").distinct()
    texts = some.groupBy("_host", "_content", "all_lines", "all_words").agg(F.collect_set(F.struct("hash", "words")).alias("shared"))
    own_lines = F.col("all_lines") - F.size("shared")
    own_words = F.col("all_words") - F.aggregate("shared", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    near = (F.size("shared") >= NEAR_SHARED) & (own_lines <= 1) & (own_words < FEWEST_WORDS)
    document = F.when(near, F.xxhash64(F.sort_array("shared"))).otherwise(F.col("_content"))
    seen = texts.select("_host", document.alias("document"), F.explode("shared.hash").alias("hash"))
    return above(seen, docs, many_documents, many_share)


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose normalised form has one of the hashes."""
    lines, forms = F.split(text, "\n"), F.transform(F.split(normalised(text), "\n"), lambda x: F.btrim(x))
    both = F.arrays_zip(lines.alias("line"), forms.alias("form"))
    left = F.filter(both, lambda x: (x["form"] == "") | ~F.array_contains(gone, F.xxhash64(x["form"])))
    return F.array_join(F.transform(left, lambda x: x["line"]), "\n")


OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept", "kept_text"]


def quality(docs: DataFrame, text: str = "text", host: str = "source", id: str = "doc_id", many_documents: int = MANY_DOCUMENTS, many_share: float = MANY_SHARE) -> DataFrame:
    """docs with the base features, base_failed, removed_words, kept and kept_text: the text without its lines above the limit (as it
    is, if it has none; null stays null). Columns of docs with those names are replaced.

    kept is false if base_failed, or if the document is depleted: over half of its words are in lines above the limit, and what
    is left is fewer than 50 words or under a fifth. Null texts have no words and fail.
    A null host is a host of its own. Rows that repeat are judged alike and are one document in the counts.
    Any number of lines may share a hash with a hot line: frequencies are summed before they are shuffled, and Spark splits
    what the join then finds skewed. An empty table gives no rows.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUT])
    names = ["_id", "_host", "_content"]
    # The row is carried as one column, so that its names can't meet those used here.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id).alias("_id"), F.col(host).alias("_host"), F.xxhash64(whole_text(text)).alias("_content"), F.col(text).alias("_text"))
    lines = written(hashed_lines(rows.select(*names, normalised_lines(whole_text("_text")).alias("_lines"))), "quality-lines")
    common = written(common_lines(lines, rows.select("_host"), many_documents, many_share), "common-lines")
    removed = (
        lines.join(common, lines["_host"].eqNullSafe(common["host"]) & (lines["hash"] == common["hash"]))
        .select(*names, "place", "words", lines["hash"].alias("_hash"))
        .groupBy(*names, "place")  # rows that repeat have each line once
        .agg(F.max("words").alias("words"), F.max("_hash").alias("_hash"))
        .groupBy(*names)
        .agg(F.sum("words").alias("removed_words"), F.collect_set("_hash").alias("_gone"))
    )
    removed = written(removed, "removed-words")
    for last in (lines, common):  # what follows reads removed alone
        drop_table(last)
    # Only documents with such a line are shuffled, with what is needed of them.
    marked = with_maybe(rows, ["_id", "_content"], key_filter(removed, ["_id", "_content"]))
    some, rest = (base_features(marked.filter(side).drop("_maybe")) for side in ("_maybe", "not _maybe"))
    found = some.alias("d").join(removed.alias("r"), [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names], "left")
    features = OUT[:6]

    def shown(table: DataFrame, at: str, gone: Column, kept_text: Column) -> DataFrame:
        n = F.col(f"{at}n_words")
        depleted = (2 * gone > n) & ((n - gone < FEWEST_WORDS) | (5 * gone > 4 * n))
        more = {"removed_words": gone, "kept": ~F.col(f"{at}base_failed") & ~depleted, "kept_text": kept_text}
        return table.select(*[F.col(f"{at}_row")[c].alias(c) for c in docs.columns], *[F.col(f"{at}{c}").alias(c) for c in features], *[c.alias(k) for k, c in more.items()])

    touched = shown(found, "d.", F.coalesce("r.removed_words", F.lit(0).cast("long")), F.when(F.col("r._gone").isNotNull(), without_lines(F.col("d._text"), F.col("r._gone"))).otherwise(F.col("d._text")))
    return touched.unionByName(shown(rest, "", F.lit(0).cast("long"), F.col("_text")))


def op9(spark, sf_dir: str) -> DataFrame:
    out = quality(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
