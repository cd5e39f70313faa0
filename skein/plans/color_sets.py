"""Queries over sets of integers: for each order the months in which its lines are shipped.

The queries large_* are over large sets of high numbers, where bitmaps over a superset pay off: for each supplier and year the orders
that it has had a line of until then, and for each line number the first orders that have one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.sets import set_text
from skein.operators import encode, forest, sets
from skein.session import checkpointed, free_shuffles, stored, tables_dir, tasks_for
from skein.sources import files

LIMIT, WIDTH, SPARSE_WIDTH = 2, 12, 16
#: Of the large sets: the last year that is counted, and the orders of those by line number.
LAST_YEAR, DENSE_ORDERS = 2001, 400
#: Bytes of the lines that are one task's.
DEALT_BYTES = 4 << 20


def _sets(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.month("l_shipdate").alias("month"))
    return sets.number_sets(sets.collect_sets(rows, "l_orderkey", "month"), [F.col("n"), F.col("l_orderkey")])


def _until_each_year(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """l_suppkey, x, year (of its lines) to key, elems, n: for each year from its first on the distinct x until then, ascending."""
    for batch in batches:
        for supplier, xs, years in zip(*(batch.column(k) for k in range(3)), strict=True):
            x, year = xs.values.to_numpy(), years.values.to_numpy()
            order = np.lexsort((year, x))
            x, year = x[order], year[order]
            first = np.concatenate(([True], x[1:] != x[:-1]))
            x, year = x[first], year[first]
            each = np.arange(year.min(), LAST_YEAR + 1)
            found = [x[year <= y] for y in each]
            n = np.array([len(f) for f in found], np.int64)
            elems = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([pa.array(supplier.as_py() * 10000 + each.astype(np.int64)), elems, pa.array(n)], names=["key", "elems", "n"])


def _large(spark, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_linenumber", F.year("l_shipdate").alias("year")).filter(F.col("year") <= LAST_YEAR)
    by_number = lines.filter(F.col("l_orderkey") <= DENSE_ORDERS).select(F.col("l_linenumber").cast("long").alias("key"), "l_orderkey")
    # A supplier's lines meet once, and its sets are made of them. Lines without a supplier, and those whose keys may be line numbers' too, meet by key.
    odd = by_number.select(F.floor(F.col("key") / 10000).alias("l_suppkey")).distinct()
    marked = lines.join(odd.withColumn("odd", F.lit(True)), "l_suppkey", "left").withColumn("odd", F.coalesce("odd", F.col("l_suppkey").isNull()))
    until = marked.filter("odd").select("l_orderkey", "l_suppkey", F.explode(F.sequence("year", F.lit(LAST_YEAR))).alias("year"))
    by_key = until.select((F.col("l_suppkey") * 10000 + F.col("year")).alias("key"), "l_orderkey")
    own = marked.filter("not odd and l_orderkey is not null").select("l_suppkey", F.col("l_orderkey").cast("long").alias("x"), "year")
    own = own.repartition(tasks_for(lines, DEALT_BYTES), "l_suppkey").groupBy("l_suppkey").agg(F.collect_list("x").alias("x"), F.collect_list("year").alias("year"))
    own = own.mapInArrow(_until_each_year, "key long, elems array<long>, n long")
    rows = stored(own.unionByName(sets.collect_sets(by_key.unionByName(by_number), "key", "l_orderkey")), "large")
    free_shuffles(spark)
    numbers = stored(sets.number_sets(rows.select("key", "n"), [F.col("n"), F.col("key")]).select("key", "set_id"), "numbers")
    free_shuffles(spark)
    return rows.join(numbers, rows["key"].eqNullSafe(numbers["key"])).select("set_id", rows["key"], "n", "elems")


def _descending(spark, sf_dir: str) -> DataFrame:
    rows = _sets(spark, sf_dir).withColumnRenamed("set_id", "old_id")
    return sets.number_sets(rows, [F.desc("n"), F.desc("old_id")])


def color_sets(spark, sf_dir):
    return _sets(spark, sf_dir).select("set_id", "l_orderkey", "n", set_text(F.col("elems")).alias("elems"))


def sets_descending(spark, sf_dir):
    return _descending(spark, sf_dir).select("set_id", "old_id", "n", set_text(F.col("elems")).alias("elems"))


def set_offsets(spark, sf_dir):
    return sets.offsets(_sets(spark, sf_dir))


def count_subsets(spark, sf_dir):
    return sets.subset_counts(_descending(spark, sf_dir))


def extract_supersets(spark, sf_dir):
    return sets.kept_supersets(_descending(spark, sf_dir)).select("set_id", set_text(F.col("elems")).alias("elems"))


def count_subsets_ascending(spark, sf_dir):
    rows = _sets(spark, sf_dir)
    found = sets.later_superset(rows, strict=False).filter("parent_id >= 0")
    sized = found.join(rows.select(F.col("set_id").alias("parent_id"), "n"), "parent_id")
    return sized.agg(F.count(F.lit(1)).alias("subsets"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("subset_bits"))


def count_contiguous(spark, sf_dir):
    return sets.contiguous_counts(_descending(spark, sf_dir))


def _forest(spark, sf_dir):
    rows = _sets(spark, sf_dir)
    return rows, sets.later_superset(rows)


def find_parents(spark, sf_dir):
    return _forest(spark, sf_dir)[1]


def parent_stats(spark, sf_dir):
    root = F.col("parent_id") < 0
    return _forest(spark, sf_dir)[1].agg(F.count_if(root).alias("roots"), F.count_if(~root).alias("subsets"))


def forest_top_down(spark, sf_dir):
    return forest.limit_top_down(_forest(spark, sf_dir)[1], LIMIT)


def forest_bottom_up(spark, sf_dir):
    return forest.limit_bottom_up(_forest(spark, sf_dir)[1], LIMIT)


def forest_last_node(spark, sf_dir):
    return forest.limit_last_node(_forest(spark, sf_dir)[1], LIMIT)


def forest_contracted(spark, sf_dir):
    rows, parents = _forest(spark, sf_dir)
    return forest.contract(parents, rows)


def _grown(rows: DataFrame, parents: DataFrame, width: int, limit: int | None) -> DataFrame:
    size = rows.select("set_id", F.col("n").alias("own"))
    up = rows.select(F.col("set_id").alias("parent_id"), F.col("n").alias("parent_n"))
    return forest.grow_trees(parents.join(size, "set_id").join(up, "parent_id", "left"), F.col("own") * width > F.col("parent_n"), limit, 1)


def tree_depth(spark, sf_dir):
    """First strict superset; a set that is far smaller than it stays a root."""
    rows, parents = _forest(spark, sf_dir)
    return forest.tree_report(_grown(rows, parents, SPARSE_WIDTH, None), rows)


def tree_estimate(spark, sf_dir):
    """The same with a limit of depth and a width."""
    rows, parents = _forest(spark, sf_dir)
    return forest.tree_report(_grown(rows, parents, WIDTH, 3), rows)


def large_sets(spark, sf_dir):
    return _large(spark, sf_dir).select("set_id", "key", "n", F.md5(set_text(F.col("elems"))).alias("md5"))


def large_parents(spark, sf_dir):
    return sets.later_superset(_large(spark, sf_dir))


def large_tree(spark, sf_dir):
    """Trees with the rule that far smaller sets stay roots, what their roots take, and by kind."""
    rows = _large(spark, sf_dir)
    grown = checkpointed(_grown(rows, sets.later_superset(rows), 2, 3))
    return forest.tree_report(grown, rows).crossJoin(forest.root_kinds(grown, rows, encode.element_width(rows)))  # one row by one row


def _large_classified(spark, sf_dir):
    rows = _large(spark, sf_dir)
    return rows, forest.limit_top_down(sets.later_superset(rows), LIMIT), encode.element_width(rows)


def large_kinds(spark, sf_dir):
    return encode.new_ids(encode.classify(*_large_classified(spark, sf_dir))).select("new_id", "set_id", "kind", "dense_bits", "sparse_bits")


def large_stats(spark, sf_dir):
    return encode.store_stats(encode.classify(*_large_classified(spark, sf_dir)))


def large_starts(spark, sf_dir):
    return encode.container_starts(encode.new_ids(encode.classify(*_large_classified(spark, sf_dir))))


def large_extract(spark, sf_dir):
    """The store written, read again and decoded: subsets through their parents."""
    rows, parents, width = _large_classified(spark, sf_dir)
    path = f"{tables_dir(spark)}/store-{uuid.uuid4().hex}"
    encode.write_store(encode.build_store(rows, parents, width), path)
    return encode.extract(encode.read_store(spark, path)).select("set_id", F.md5(set_text(F.col("elems"))).alias("md5"))


def large_search(spark, sf_dir):
    return _searched(_large(spark, sf_dir))


def set_files(spark, sf_dir):
    """The sets as length-prefixed 32-bit words in one file, read again with their places."""
    path = f"{tables_dir(spark)}/sets-{uuid.uuid4().hex}"
    files.write_bytes(spark, path, files.joined_bytes(files.set_words(_sets(spark, sf_dir)), "set_id"))
    return files.read_sets(spark, path).select("set_id", "word_offset", set_text(F.col("elems")).alias("elems"))


def parent_files(spark, sf_dir):
    """The parents as 64-bit numbers in one file, read again."""
    path = f"{tables_dir(spark)}/parents-{uuid.uuid4().hex}"
    files.write_bytes(spark, path, files.joined_bytes(files.number_bytes(find_parents(spark, sf_dir), "set_id", "parent_id", 8), "set_id"))
    return files.read_parents(spark, path)


def tree_walk(spark, sf_dir):
    """Trees by the latest earlier superset under one root: how many have any, how deep they are, and what subsets and roots take."""
    rows = _descending(spark, sf_dir)
    found = stored(sets.latest_in_tree(rows), "walked")
    free_shuffles(spark)
    deep = forest.tree_depths(found)
    sized = found.join(rows.select(F.col("set_id").alias("ancestor"), F.col("n").alias("bits")), "ancestor", "left").join(rows.select("set_id", "n"), "set_id")
    cost = sized.agg(F.coalesce(F.sum("bits"), F.lit(0)).alias("subset_bits"), F.sum(F.when(F.col("ancestor").isNull(), F.col("n"))).alias("root_elements"))
    shape = deep.agg(F.count(F.lit(1)).alias("trees"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"))
    return shape.crossJoin(cost)  # one row by one row


def _searched(rows: DataFrame) -> DataFrame:
    pointer, width = len(f"{rows.count():b}"), encode.element_width(rows)
    cheaper = (F.col("super_n") + pointer < F.coalesce(F.col("sub_max") + 1, F.lit(0))) & (F.col("super_n") + pointer < F.col("sub_n") * width)
    grown = forest.grow_trees(sets.later_superset(rows, accept=cheaper), F.lit(True), 5, 0)
    return encode.store_stats(encode.classify(rows, grown.select("set_id", "parent_id"), width))


def store_search(spark, sf_dir):
    """Parents found by cost: the first larger superset for which a bitmap is cheaper than both other kinds, down to a limit of depth."""
    return _searched(_sets(spark, sf_dir))


def _classified(spark, sf_dir):
    rows, parents = _forest(spark, sf_dir)
    width = encode.element_width(rows)
    return rows, forest.limit_top_down(parents, LIMIT), width


def store_kinds(spark, sf_dir):
    return encode.new_ids(encode.classify(*_classified(spark, sf_dir))).select("new_id", "set_id", "kind", "dense_bits", "sparse_bits")


def store_stats(spark, sf_dir):
    return encode.store_stats(encode.classify(*_classified(spark, sf_dir)))


def store_starts(spark, sf_dir):
    return encode.container_starts(encode.new_ids(encode.classify(*_classified(spark, sf_dir))))


def store_extract(spark, sf_dir):
    rows, parents, width = _classified(spark, sf_dir)
    return encode.extract(encode.build_store(rows, parents, width)).select("set_id", set_text(F.col("elems")).alias("elems"))


def sample_sets(spark, sf_dir):
    """A sampling operator: a hundred sets, the largest first."""
    return sets.sample_sets(_sets(spark, sf_dir), 100, by_size=True).select("set_id", "n", set_text(F.col("elems")).alias("elems"))


QUERIES = {
    f.__name__: f
    for f in (
        color_sets, sets_descending, set_offsets, count_subsets, extract_supersets, count_subsets_ascending, count_contiguous, find_parents, parent_stats,
        forest_top_down, forest_bottom_up, forest_last_node, forest_contracted, tree_depth, tree_estimate, tree_walk, store_search, store_kinds, store_stats, store_starts, store_extract, sample_sets,
        large_sets, large_parents, large_tree, large_kinds, large_stats, large_starts, large_extract, large_search, set_files, parent_files,
    )
}

_SETS = """
s AS (SELECT l_orderkey, list_sort(list_distinct(list(month(l_shipdate)::BIGINT))) AS e FROM lineitem GROUP BY 1),
sets AS (SELECT row_number() OVER (ORDER BY len(e), l_orderkey) - 1 AS set_id, l_orderkey, len(e)::BIGINT AS n, e, list_sum(list_transform(e, lambda x: 1 << x))::BIGINT AS m,
                '{' || array_to_string(e, ', ') || '}' AS elems FROM s),
down AS (SELECT row_number() OVER (ORDER BY n DESC, set_id DESC) - 1 AS set_id, set_id AS old_id, n, e, m, elems FROM sets)"""
_EARLIER = (
    _SETS
    + """,
kinds AS (SELECT m, min(set_id) AS least FROM down GROUP BY m),
firsts AS (SELECT a.m, min(b.least) AS least FROM kinds a JOIN kinds b ON (a.m & b.m) = a.m GROUP BY a.m),
found AS (SELECT d.*, CASE WHEN f.least < d.set_id THEN f.least END AS earlier FROM down d JOIN firsts f USING (m))"""
)
_PARENTS = (
    _SETS
    + """,
kinds AS (SELECT m, n, min(set_id) AS least FROM sets GROUP BY m, n),
ups AS (SELECT a.m, min(b.least) AS up FROM kinds a JOIN kinds b ON (a.m & b.m) = a.m AND b.n > a.n GROUP BY a.m),
parents AS (SELECT set_id, s.n, coalesce(u.up, -1) AS parent_id FROM sets s LEFT JOIN ups u USING (m))"""
)
_CLOSURE = (
    _PARENTS
    + """,
closure AS (
  SELECT set_id, parent_id AS ancestor, 1 AS d FROM parents WHERE parent_id >= 0
  UNION ALL SELECT c.set_id, p.parent_id, c.d + 1 FROM closure c JOIN parents p ON p.set_id = c.ancestor WHERE p.parent_id >= 0),
deep AS (SELECT p.set_id, p.n, p.parent_id, coalesce(max(c.d), 0) AS depth, coalesce(arg_max(c.ancestor, c.d), p.set_id) AS root FROM parents p LEFT JOIN closure c ON c.set_id = p.set_id GROUP BY p.set_id, p.n, p.parent_id)"""
)
_KINDS = (
    _CLOSURE
    + """,
limited AS (SELECT set_id, CASE WHEN depth > 1 AND (depth - 1) % 2 = 0 THEN root ELSE parent_id END AS parent_id FROM deep),
sized AS (
  SELECT s.set_id, s.n, s.elems, list_max(s.e) + 1 AS dense_bits, s.n * (SELECT max(length(bin(list_max(e)))) FROM sets) AS sparse_bits,
         p.n AS parent_n, p.n + length(bin((SELECT count(*) FROM sets))) AS subset_bits
  FROM sets s JOIN limited l USING (set_id) LEFT JOIN sets p ON p.set_id = l.parent_id),
kinds2 AS (
  SELECT *, CASE WHEN subset_bits < dense_bits AND subset_bits < sparse_bits THEN 'subset' WHEN dense_bits < sparse_bits THEN 'dense' ELSE 'sparse' END AS kind FROM sized),
numbered AS (SELECT *, row_number() OVER (ORDER BY kind, set_id) - 1 AS new_id FROM kinds2)"""
)
_STATS = "SELECT kind, count(*) AS sets, sum(n)::BIGINT AS colors, sum(CASE kind WHEN 'dense' THEN dense_bits WHEN 'sparse' THEN sparse_bits ELSE subset_bits END)::BIGINT AS bits, sum(CASE kind WHEN 'dense' THEN dense_bits WHEN 'sparse' THEN sparse_bits ELSE subset_bits END) / sum(n) AS bits_per_color FROM numbered GROUP BY kind"
_STARTS = "SELECT new_id, kind, coalesce(sum(CASE kind WHEN 'dense' THEN dense_bits WHEN 'sparse' THEN n ELSE parent_n END) OVER (PARTITION BY kind ORDER BY new_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM numbered"
_LARGE = """
t AS (
  SELECT l_suppkey * 10000 + unnest(range(year(l_shipdate), 2002)) AS key, l_orderkey FROM lineitem WHERE year(l_shipdate) <= 2001
  UNION ALL SELECT l_linenumber, l_orderkey FROM lineitem WHERE l_orderkey <= 400 AND year(l_shipdate) <= 2001),
s AS (SELECT key, list_sort(list_distinct(list(l_orderkey))) AS e FROM t GROUP BY 1),
sets AS (SELECT row_number() OVER (ORDER BY len(e), key) - 1 AS set_id, key, len(e)::BIGINT AS n, e, md5('{' || array_to_string(e, ', ') || '}') AS elems FROM s),
places AS (SELECT set_id, n, e, unnest(e) AS x FROM sets),
rare AS (SELECT set_id, arg_min(x, many) AS x FROM places JOIN (SELECT x, count(*) AS many FROM places GROUP BY x) USING (x) GROUP BY set_id),
ups AS (SELECT a.set_id, min(b.set_id) AS up FROM sets a JOIN rare r USING (set_id) JOIN places b ON b.x = r.x AND b.n > a.n AND b.set_id > a.set_id WHERE list_has_all(b.e, a.e) GROUP BY a.set_id),
parents AS (SELECT set_id, n, coalesce(up, -1) AS parent_id FROM sets LEFT JOIN ups USING (set_id))"""
_LARGE_KINDS = _LARGE + _KINDS[len(_PARENTS) :]

ORACLE_SQL = {
    "large_sets": f"WITH {_LARGE} SELECT set_id, key, n, elems AS md5 FROM sets",
    "large_parents": f"WITH {_LARGE} SELECT set_id, parent_id FROM parents",
    "large_kinds": f"WITH RECURSIVE {_LARGE_KINDS} SELECT new_id, set_id, kind, dense_bits, sparse_bits FROM numbered",
    "large_stats": f"WITH RECURSIVE {_LARGE_KINDS} {_STATS}",
    "large_starts": f"WITH RECURSIVE {_LARGE_KINDS} {_STARTS}",
    "large_extract": f"WITH {_LARGE} SELECT set_id, elems AS md5 FROM sets",
    "set_files": f"WITH {_SETS} SELECT set_id, coalesce(sum(n + 1) OVER (ORDER BY set_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS word_offset, elems FROM sets",
    "parent_files": f"WITH {_PARENTS} SELECT set_id, parent_id FROM parents",
    "sample_sets": f"WITH {_SETS} SELECT set_id, n, elems FROM sets ORDER BY md5('0:' || set_id::VARCHAR), set_id LIMIT 100",
    "color_sets": f"WITH {_SETS} SELECT set_id, l_orderkey, n, elems FROM sets",
    "sets_descending": f"WITH {_SETS} SELECT set_id, old_id, n, elems FROM down",
    "set_offsets": f"WITH {_SETS} SELECT set_id, n, coalesce(sum(n + 1) OVER (ORDER BY set_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS word_offset FROM sets",
    "count_subsets": f"WITH {_EARLIER} SELECT count(*) AS sets, count(earlier) AS subsets, coalesce(sum((SELECT n FROM down x WHERE x.set_id = earlier)), 0)::BIGINT AS subset_bits, coalesce(sum(CASE WHEN earlier IS NULL THEN n END), 0)::BIGINT AS root_elements FROM found",
    "extract_supersets": f"WITH {_EARLIER} SELECT set_id, elems FROM found WHERE earlier IS NULL",
    "count_subsets_ascending": f"""WITH {_PARENTS},
following AS (SELECT set_id, n, m, lead(set_id) OVER (PARTITION BY m ORDER BY set_id) AS equal_id FROM sets),
least AS (SELECT f.set_id, least(f.equal_id, u.up) AS j FROM following f LEFT JOIN ups u USING (m))
SELECT count(*) AS subsets, coalesce(sum(s.n), 0)::BIGINT AS subset_bits FROM least JOIN sets s ON s.set_id = least.j""",
    "count_contiguous": f"""WITH {_SETS},
kinds AS (SELECT m, min(set_id) AS least, ',' || array_to_string(any_value(e), ',') || ',' AS t FROM down GROUP BY m),
firsts AS (SELECT a.m, min(b.least) AS least FROM kinds a JOIN kinds b ON contains(b.t, a.t) GROUP BY a.m)
SELECT count(*) AS sets, count(*) FILTER (WHERE f.least < d.set_id) AS contained FROM down d JOIN firsts f USING (m)""",
    "find_parents": f"WITH {_PARENTS} SELECT set_id, parent_id FROM parents",
    "parent_stats": f"WITH {_PARENTS} SELECT count(*) FILTER (WHERE parent_id < 0) AS roots, count(*) FILTER (WHERE parent_id >= 0) AS subsets FROM parents",
    "forest_top_down": f"WITH RECURSIVE {_CLOSURE} SELECT set_id, CASE WHEN depth > 1 AND (depth - 1) % 2 = 0 THEN root ELSE parent_id END AS parent_id FROM deep",
    "forest_bottom_up": f"WITH RECURSIVE {_CLOSURE} SELECT set_id, CASE WHEN depth % 3 = 0 THEN -1 ELSE parent_id END AS parent_id FROM deep",
    "forest_last_node": f"WITH RECURSIVE {_CLOSURE} SELECT x.set_id, coalesce(c.ancestor, x.parent_id) AS parent_id FROM deep x LEFT JOIN closure c ON c.set_id = x.set_id AND x.depth > 2 AND x.depth - c.d = 1",
    "forest_contracted": f"""WITH RECURSIVE {_CLOSURE},
far AS (SELECT c.set_id, arg_max(c.ancestor, c.d) AS far FROM closure c JOIN sets s USING (set_id) JOIN sets a ON a.set_id = c.ancestor WHERE a.n <= 2 * s.n GROUP BY 1)
SELECT p.set_id, coalesce(f.far, p.parent_id) AS parent_id FROM parents p LEFT JOIN far f USING (set_id)""",
    "store_kinds": f"WITH RECURSIVE {_KINDS} SELECT new_id, set_id, kind, dense_bits, sparse_bits FROM numbered",
    "store_stats": f"WITH RECURSIVE {_KINDS} {_STATS}",
    "store_starts": f"WITH RECURSIVE {_KINDS} {_STARTS}",
    "store_extract": f"WITH {_SETS} SELECT set_id, elems FROM sets",
}
