import random

import pytest
from pyspark.sql import functions as F

from skein.functions.sets import contains_run
from skein.operators import encode, forest, sets

GIVEN = [[2], [7], [1, 2], [2, 3], [1, 2, 3], [2, 3, 9], [1, 2, 3, 4], [1, 2, 3, 4, 5, 6, 7, 8]]
PARENTS = [2, 7, 4, 4, 6, -1, 7, -1]


def table(spark, collection):
    return spark.createDataFrame([(k, s, len(s)) for k, s in enumerate(collection)], "set_id long, elems array<bigint>, n long")


def parents_table(spark, parents):
    return spark.createDataFrame(list(enumerate(parents)), "set_id long, parent_id long")


def column(df, name="parent_id"):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r["set_id"])]


def collections():
    rng = random.Random(11)
    for k in range(4):
        some = [sorted(rng.sample(range(8), rng.randint(0, 6))) for _ in range(25)]
        yield some if k % 2 else sorted(some, key=len)
    yield []


def test_golden_forest(spark):
    rows = table(spark, GIVEN)
    parents = sets.later_superset(rows)
    assert column(parents) == PARENTS
    assert column(forest.contract(parents, rows)) == [2, 7, 6, 6, 6, -1, 7, -1]
    assert encode.element_width(rows) == 4
    kinds = sorted(encode.classify(rows, parents, 4).collect(), key=lambda r: r["set_id"])
    assert [(r["dense_bits"], r["sparse_bits"], r["subset_bits"]) for r in kinds] == [(3, 4, 6), (8, 4, 12), (3, 8, 7), (4, 8, 7), (4, 12, 8), (10, 12, None), (5, 16, 12), (9, 32, None)]
    assert [r["kind"] for r in kinds] == ["dense", "sparse"] + ["dense"] * 6
    down = table(spark, GIVEN[::-1])
    counts = sets.subset_counts(down).first()
    assert (counts["subsets"], counts["subset_bits"], counts["root_elements"]) == (6, 48, 11)


def test_depth_rules_on_a_chain(spark):
    chain = parents_table(spark, [1, 2, 3, 4, 5, 6, 7, -1])  # depth of set k: 7 - k

    def depth(parents):
        up = {r["set_id"]: r["parent_id"] for r in parents.collect()}
        out = []
        for k in reversed(range(8)):
            d, x = 0, k
            while up[x] >= 0:
                d, x = d + 1, up[x]
            out.append(d)
        return out

    assert depth(forest.limit_bottom_up(chain, 2)) == [0, 1, 2, 0, 1, 2, 0, 1]
    assert depth(forest.limit_top_down(chain, 2)) == [0, 1, 2, 1, 2, 1, 2, 1]
    assert depth(forest.limit_last_node(chain, 2)) == [0, 1, 2, 2, 2, 2, 2, 2]
    assert max(depth(forest.limit_top_down(chain, 0))) == 1


@pytest.mark.parametrize("collection", list(collections()))
def test_containment_against_brute_force(spark, collection):
    rows = table(spark, collection)
    n, has = len(collection), [set(s) for s in collection]
    later = [next((j for j in range(i + 1, n) if len(has[j]) > len(has[i]) and has[i] <= has[j]), -1) for i in range(n)]
    assert column(sets.later_superset(rows)) == later
    loose = [next((j for j in range(i + 1, n) if has[i] <= has[j]), -1) for i in range(n)]
    assert column(sets.later_superset(rows, strict=False)) == loose
    first = [next((i for i in range(j) if has[j] <= has[i]), None) for j in range(n)]
    assert column(sets.earlier_superset(rows), "earlier") == first
    text = [",".join(map(str, s)) for s in collection]
    part = [any((f",{text[j]}," in f",{text[i]}," if collection[j] else bool(collection[i])) for i in range(j)) for j in range(n)]
    found = sets.contiguous_counts(rows).first()
    assert (found["sets"], found["contained"]) == (n, sum(part)) if n else found["contained"] in (0, None)
    offset, exp = 0, []
    for s in collection:
        exp.append(offset)
        offset += len(s) + 1
    assert column(sets.offsets(rows), "word_offset") == exp


def brute_grow(collection, parents, accepts, limit):
    depth, out = [1] * len(collection), [-1] * len(collection)
    for i, p in enumerate(parents):
        if p >= 0 and accepts(len(collection[i]), len(collection[p])) and (limit is None or depth[i] + 1 <= limit):
            out[i] = p
            depth[p] = max(depth[p], depth[i] + 1)
    return out, depth


@pytest.mark.parametrize("width, limit", [(16, None), (2, 3), (12, 2)])
def test_trees_against_brute_force(spark, width, limit):
    collection = sorted([[k % 5, 5 + k % 3, 8 + k % 7][: 1 + k % 3] for k in range(20)] + GIVEN + [list(range(20))], key=lambda s: (len(s), s))
    collection = [sorted(set(s)) for s in collection]
    collection.sort(key=lambda s: (len(s), s))
    rows = table(spark, collection)
    parents = sets.later_superset(rows)
    own, up = rows.select("set_id", F.col("n").alias("own")), rows.select(F.col("set_id").alias("parent_id"), F.col("n").alias("parent_n"))
    grown = forest.grow_trees(parents.join(own, "set_id").join(up, "parent_id", "left"), F.col("own") * width > F.col("parent_n"), limit, 1)
    exp, depth = brute_grow(collection, column(parents), lambda a, b: a * width > b, limit)
    assert column(grown) == exp and column(grown, "depth") == depth
    report = forest.tree_report(grown, rows).first()
    roots = [k for k, p in enumerate(exp) if p < 0]
    assert (report["trees"], report["max_depth"], report["root_elements"]) == (len(roots), max(depth), sum(len(collection[k]) for k in roots))


def test_store_gives_back_every_set(spark):
    big = list(range(1000, 1060))
    collection = [[], [3], [1, 2], big[:50], big[:30], big, list(range(12)), [1, 2]]
    collection.sort(key=len)
    rows = table(spark, collection)
    parents = sets.later_superset(rows)
    width = encode.element_width(rows)
    store = encode.build_store(rows, parents, width)
    kinds = {r["kind"] for r in store.collect()}
    assert kinds == {"dense", "sparse", "subset"}
    assert column(encode.extract(store), "elems") == collection
    assert column(encode.extract(store, rows.filter("set_id = 6")), "elems") == [collection[6]]
    ids = sorted((r["new_id"], r["kind"], r["set_id"]) for r in store.collect())
    assert [x[1:] for x in ids] == sorted((x[1:] for x in ids), key=lambda x: (encode.KINDS.index(x[0]), x[1]))
    starts = encode.container_starts(encode.new_ids(encode.classify(rows, parents, width))).collect()
    assert min(r["first"] for r in starts) == 0


def test_contiguous_parts_and_samples(spark):
    pairs = [([1, 2, 3], [2, 3], True), ([1, 2, 3], [1, 3], False), ([1], [], True), ([], [], False), ([], [1], False)]
    df = spark.createDataFrame(pairs, "a array<int>, b array<int>, e boolean")
    assert all(r["e"] == r["x"] for r in df.withColumn("x", contains_run(F.col("a"), F.col("b"))).collect())
    rows = table(spark, GIVEN)
    drawn = sets.sample_sets(rows, 3, seed=1, by_size=True).collect()
    assert len({r["set_id"] for r in drawn}) == 3 and [(r["n"], r["set_id"]) for r in drawn] == sorted(((r["n"], r["set_id"]) for r in drawn), reverse=True)
    places = [r["pos"] for r in sets.sample_positions(spark, 50, 10, 40, seed=3).collect()]
    assert len(places) == 50 and places == sorted(places) and max(places) < 30
    with pytest.raises(ValueError):
        sets.sample_positions(spark, 1, 10, 10)


@pytest.mark.parametrize("collection", list(collections()))
def test_latest_superset_under_one_root(spark, collection):
    rows = table(spark, collection)
    has = [set(s) for s in collection]
    root = [next((i for i in range(j) if has[j] <= has[i]), None) for j in range(len(has))]
    exp = [None if r is None else max((j for j in range(i) if root[j] == r and has[i] <= has[j]), default=r) for i, r in enumerate(root)]
    found = sets.latest_in_tree(rows)
    assert column(found, "root") == root and column(found, "ancestor") == exp


def test_parents_by_cost(spark):
    big = list(range(500, 560))
    collection = sorted([big[: 10 + 7 * k] for k in range(8)] + [big[3 : 9 + 5 * k] for k in range(8)] + GIVEN, key=len)
    rows = table(spark, collection)
    pointer, width = len(f"{len(collection):b}"), encode.element_width(rows)
    cheaper = (F.col("super_n") + pointer < F.col("sub_max") + 1) & (F.col("super_n") + pointer < F.col("sub_n") * width)
    found = sets.later_superset(rows, accept=cheaper)
    has, depth, exp = [set(s) for s in collection], [0] * len(collection), [-1] * len(collection)
    for i, s in enumerate(collection):
        for j in range(i + 1, len(collection)):
            cost = len(collection[j]) + pointer
            if len(s) < len(collection[j]) and has[i] <= has[j] and cost < s[-1] + 1 and cost < len(s) * width and depth[i] + 1 <= 3:
                exp[i] = j
                depth[j] = max(depth[j], depth[i] + 1)
                break
    grown = forest.grow_trees(found, F.lit(True), 3, 0)
    assert column(grown) == exp and any(p >= 0 for p in exp)
    store = encode.build_store(rows, grown.select("set_id", "parent_id"), width)
    assert column(encode.extract(store), "elems") == collection


def test_chains_take_few_rounds_and_rows(spark):
    n = 3000
    chain = spark.range(n).select(F.col("id").alias("set_id"), F.when(F.col("id") < n - 1, F.col("id") + 1).otherwise(F.lit(-1)).alias("parent_id"))
    up = forest.lifts(chain)
    assert len(up) == 12 and sum(x.count() for x in up) < 12 * n
    assert forest.depths(chain, up).agg(F.max("depth"), F.min("root"), F.max("root")).first() == (n - 1, n - 1, n - 1)
    last = {r["set_id"]: r["parent_id"] for r in forest.limit_last_node(chain, 10).collect()}
    assert all(last[k] == (n - 10 if n - 1 - k > 10 else chain_parent) for k, chain_parent in ((k, k + 1 if k < n - 1 else -1) for k in range(n)))


def test_roots_by_kind(spark):
    rows = spark.createDataFrame([(0, [0, 1, 2], 3), (1, [900], 1), (2, [1, 2, 900], 3)], "set_id long, elems array<bigint>, n long")
    grown = spark.createDataFrame([(0, -1), (1, 2), (2, -1)], "set_id long, parent_id long")
    assert tuple(forest.root_kinds(grown, rows, 10).first()) == (1, 1, 3, 30)


def test_large_sets_meet_by_their_ids(spark, monkeypatch):
    """Elements aren't sent once for each element of their set; and what is found doesn't depend on which sets are carried."""
    chain = table(spark, [list(range(100 * k + 100)) for k in range(30)])
    before = shuffled(spark)
    assert column(sets.later_superset(chain)) == [*range(1, 30), -1]
    assert shuffled(spark) - before < 10e6  # 75 million elements if each of a set's took all of them along
    rows = table(spark, next(collections()))
    found = column(sets.later_superset(rows, strict=False))
    monkeypatch.setattr(sets, "CARRIED", 2)
    assert column(sets.later_superset(rows, strict=False)) == found


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_trees_of_equal_sets_are_lifted_by_runs(spark):
    """Depths are those of the sets' chains, also where other sets lie between equal ones; runs of equal sets take few tables."""
    rng = random.Random(3)
    for collection in ([[1, 2, 3]] * 30 + [[1, 2]] * 40 + [[1]] * 50, [sorted(rng.sample(range(4), rng.randint(1, 3))) for _ in range(60)]):
        found = sets.latest_in_tree(table(spark, collection))
        rows = {r["set_id"]: r for r in found.collect()}
        deep, exp = {}, {}
        for k in sorted(rows):
            earlier = [j for j in range(k) if set(collection[k]) <= set(collection[j])]
            root = min(earlier, default=None)
            same = [j for j in earlier if rows[j]["root"] == root]
            assert (rows[k]["root"], rows[k]["ancestor"]) == (root, max(same, default=root))
            deep[k] = 0 if root is None else deep[rows[k]["ancestor"]] + 1
            if root is not None:
                exp[root] = max(exp.get(root, 0), deep[k])
        assert {r["root"]: r["depth"] for r in forest.tree_depths(found).collect()} == exp


def test_containment_sends_no_elements_of_sets_without_a_copy(spark, monkeypatch):
    """F10 F11 F12: sets meet by ids and digests; parts of the pairs are compared one after the other."""
    rng = random.Random(3)
    base = [sorted(rng.sample(range(10_000), 200)) for _ in range(6)]
    some = sorted([sorted(rng.sample(b, k)) for b in base for k in (1, 3, 70, 150)] + base + base[:2] + [[]], key=len)
    exp = [next((j for j in range(k + 1, len(some)) if len(some[j]) > len(s) and set(s) <= set(some[j])), -1) for k, s in enumerate(some)]
    rows = table(spark, some)
    assert "elems" not in sets.copied(rows).columns and sets.copied(rows).count() == 4
    monkeypatch.setattr(sets, "PARTS", 2)
    monkeypatch.setattr(sets, "PART", 1000)
    assert column(sets.later_superset(rows)) == exp
