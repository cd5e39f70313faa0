"""Collections of integer sets: order, sampling, and containment as an equi-join on each set's rarest element.

set_id numbers the sets from 0 in their order. Equal sets are one class, and containment is found among classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.sets import contains_run, includes
from skein.session import drop_table, free_shuffles, stored, with_ordinal

#: Elements at most of sets that are compared where they meet; of larger ones only the ids meet, and those left are compared in full.
CARRIED = 64
#: Counters of elements, by their hash. They decide at which of its elements a set meets others, not what is found.
COUNTERS = 1 << 18
#: Rows at most of a table of ids and a few elements that is broadcast; with more the same join is a shuffle. Elements of a set that are looked up at once there.
BROADCAST, PROBES = 1 << 20, 4
#: Elements that are compared in one go, and such parts at most: each part's shuffles are deleted before the next.
PART, PARTS = 8 << 20, 16


def collect_sets(rows: DataFrame, key: str, elem: str) -> DataFrame:
    """key, elems (ascending, distinct), n."""
    return rows.filter(F.col(elem).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.col(elem).cast("long"))).alias("elems")).withColumn("n", F.size("elems").cast("long"))


def number_sets(sets: DataFrame, order: list[Column]) -> DataFrame:
    return with_ordinal(sets, order, "set_id")


def offsets(sets: DataFrame) -> DataFrame:
    """set_id, n and the word at which each set's header lies in a length-prefixed file: sums within ranges of ids, then of the ranges."""
    part = 1 << 16
    ranged = sets.select("set_id", "n", F.floor(F.col("set_id") / part).alias("r"))
    before = ranged.groupBy("r").agg(F.sum(F.col("n") + 1).alias("words")).withColumn("first", F.coalesce(F.sum("words").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    within = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("r").orderBy("set_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return ranged.withColumn("within", within).join(before.select("r", "first"), "r").select("set_id", "n", (F.col("first") + F.col("within")).alias("word_offset"))


def sample_positions(spark, count: int, size: int, n: int, seed: int = 0) -> DataFrame:
    """count starts of strings of a size in a text of n symbols, with replacement, ascending; a start that leaves no symbol behind the string isn't drawn."""
    if n <= size:
        raise ValueError("the text must be longer than a sample")
    draws = spark.range(count).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n - size)).alias("pos"))
    return draws.orderBy("pos")


def sample_text(positions: DataFrame, text: bytes, size: int) -> DataFrame:
    """pos, sample: what a dictionary is put together from, in the order of pos."""
    return positions.select("pos", F.substring(F.lit(text), (F.col("pos") + 1).cast("int"), F.lit(size)).alias("sample"))


def dictionary(positions: DataFrame, text: bytes, size: int) -> DataFrame:
    """One row, text: the samples in the order of their positions, as one. Its length is count * size, which the caller chose."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.hex("sample").alias("h")))), lambda x: x["h"])
    return sample_text(positions, text, size).agg(F.unhex(F.array_join(parts, "")).alias("text"))


def sample_sets(sets: DataFrame, count: int, seed: int = 0, by_size: bool = False) -> DataFrame:
    """So many distinct sets, by a hash of their ids; by_size: the largest first, and of those the latest. More than there are is an error."""
    if sets.count() < count:
        raise ValueError("fewer sets than samples")
    drawn = sets.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("set_id").cast("string"))), "set_id").limit(count)
    return drawn.orderBy(F.desc("n"), F.desc("set_id")) if by_size else drawn.orderBy("set_id")


def _digest() -> Column:
    """SHA-256 of a set: equal sets are found by it, without sending their elements."""
    return F.sha2(F.array_join("elems", ",").cast("binary"), 256)


def copied(sets: DataFrame) -> DataFrame:
    """set_id, class_id (the least set_id of equal sets), copies of the sets that aren't alone in their class."""
    found = stored(sets.select("set_id", _digest().alias("digest")), "digests")
    free_shuffles(sets.sparkSession)
    of = found.groupBy("digest").agg(F.min("set_id").alias("class_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    out = stored(found.join(of, "digest").select("set_id", "class_id", "copies"), "copied")
    drop_table(found)
    free_shuffles(sets.sparkSession)
    return out


def classes(sets: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """elems, n, class_id (the least set_id), copies. Elements stay where they are: sets without a copy are their own class. copies: of copied, if at hand."""
    of = copied(sets) if copies is None else copies
    first, others = of.filter("set_id = class_id").select("set_id", "copies"), of.filter("set_id != class_id").select("set_id")
    kept = sets.select("set_id", "elems").join(others, "set_id", "left_anti").join(first, "set_id", "left")
    return kept.select("elems", F.size("elems").cast("long").alias("n"), F.col("set_id").alias("class_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))


def met_at(distinct: DataFrame) -> DataFrame:
    """sub, super: classes that meet at an element of sub that few have, and at which super has some more of sub's elements."""
    spark = distinct.sparkSession
    place = F.pmod(F.xxhash64("elem"), F.lit(COUNTERS))
    elements = distinct.select("class_id", F.explode("elems").alias("elem"))
    counters = stored(elements.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("many")), "counters")
    free_shuffles(spark)
    counted = elements.withColumn("place", place).join(F.broadcast(counters), "place")  # COUNTERS rows at most
    rarest = stored(counted.groupBy(F.col("class_id").alias("sub")).agg(F.min(F.struct("many", "elem")).alias("at")).select("sub", F.col("at.elem").alias("elem")), "rarest")
    free_shuffles(spark)
    if rarest.count() > BROADCAST:
        return elements.withColumnRenamed("class_id", "super").join(rarest, "elem").filter("sub != super").select("sub", "super")
    probes = F.array_distinct(F.array(*[F.get("elems", F.floor(F.size("elems") * k / F.lit(PROBES)).cast("int")) for k in range(PROBES)]))
    some = stored(distinct.select(F.col("class_id").alias("sub"), "n", probes.alias("probes")).join(rarest, "sub").select("sub", F.col("n").alias("sub_n"), "probes", "elem"), "probes")
    supers = distinct.select(F.col("class_id").alias("super"), F.col("n").alias("super_n"), "elems", F.explode("elems").alias("elem"))
    found = supers.join(F.broadcast(some), "elem").filter((F.col("sub_n") < F.col("super_n")) & includes(F.col("elems"), F.col("probes")))
    return found.select("sub", "super")


def candidates(distinct: DataFrame) -> DataFrame:
    """sub, super (class ids) of all pairs of different classes of which one may contain the other; sub_n, super_n, sub_max (the
    largest element), open (not compared yet: one of them has over CARRIED elements).

    A superset has all of the subset's elements: subsets are sent to one that few have, and supersets to each of theirs, by their
    ids alone. The empty set, which has none, is in all others.
    """
    spark = distinct.sparkSession
    bit = F.aggregate("elems", F.lit(0).cast("long"), lambda mask, x: mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))))
    some = F.when(F.col("n") <= CARRIED, F.col("elems"))
    of = stored(distinct.select("class_id", "n", bit.alias("mask"), F.array_max("elems").alias("max"), some.alias("some")), "heads")
    one, two = (of.select(F.col("class_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in of.columns[1:]]) for name in ("sub", "super"))
    pairs = met_at(distinct).join(one, "sub").join(two, "super").filter((F.col("sub_n") < F.col("super_n")) & (F.col("sub_mask").bitwiseAND(F.col("super_mask")) == F.col("sub_mask")))
    open_ = F.col("sub_some").isNull() | F.col("super_some").isNull()
    pairs = pairs.withColumn("open", open_).filter(open_ | includes(F.col("super_some"), F.col("sub_some")))
    out = stored(pairs.select("sub", "super", "sub_n", "super_n", "sub_max", "open"), "met")
    free_shuffles(spark)
    nothing = distinct.filter("n = 0").select(F.col("class_id").alias("sub"), F.col("n").alias("sub_n"), F.lit(None).cast("long").alias("sub_max"))
    others = distinct.filter("n > 0").select(F.col("class_id").alias("super"), F.col("n").alias("super_n"))
    return out.unionByName(others.crossJoin(F.broadcast(nothing)).select("sub", "super", "sub_n", "super_n", "sub_max", F.lit(False).alias("open")))  # one class at most is empty


def compared(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs of which super has all elements of sub. Those that aren't open have been compared."""
    unsure = stored(pairs.filter("open"), "open")
    out = pairs.filter("not open")
    if unsure.isEmpty():
        return out
    size = unsure.agg(F.sum(F.col("sub_n") + F.col("super_n"))).first()[0]
    parts = int(min(PARTS, size // PART + 1))
    for k in range(parts):
        own = F.pmod(F.xxhash64(F.col("sub")), F.lit(parts)) == k
        some = unsure.filter(own)
        supers = stored(some.select(F.col("super").alias("class_id")).distinct(), "supers")
        one = distinct.select(F.col("class_id").alias("sub"), F.col("elems").alias("sub_elems")).filter(own)
        two = distinct.join(supers, "class_id", "left_semi").select(F.col("class_id").alias("super"), F.col("elems").alias("super_elems"))
        found = stored(some.join(one, "sub").join(two, "super").filter(includes(F.col("super_elems"), F.col("sub_elems"))).select(*pairs.columns), "compared")
        out = out.unionByName(found)
        drop_table(supers)
        free_shuffles(distinct.sparkSession)
    return out


def containments(distinct: DataFrame) -> DataFrame:
    """sub, super (class ids) of all pairs of different classes of which one contains the other; sub_n, super_n, sub_max (the largest element)."""
    return compared(candidates(distinct), distinct).drop("open")


def with_class(sets: DataFrame, copies: DataFrame) -> DataFrame:
    """sets with class_id. copies: of copied; a set without a copy is its own class."""
    return sets.join(copies.select("set_id", "class_id"), "set_id", "left").withColumn("class_id", F.coalesce("class_id", "set_id"))


def earlier_superset(sets: DataFrame) -> DataFrame:
    """sets with earlier: the least smaller set_id whose set has all elements of this one (equal ones too), or null.

    As containment passes on, that one has no earlier superset itself, so it is also the first that a scan in order would keep.
    """
    copies = copied(sets)
    distinct = classes(sets, copies)
    least = containments(distinct).groupBy(F.col("sub").alias("class_id")).agg(F.min("super").alias("least"))
    found = F.least("class_id", F.coalesce("least", "class_id"))
    return with_class(sets, copies).join(least, "class_id", "left").withColumn("earlier", F.when(found < F.col("set_id"), found)).drop("class_id", "least")


def subset_counts(sets: DataFrame) -> DataFrame:
    """One row: sets, subsets (with an earlier superset), subset_bits (sizes of those), root_elements (sizes of the others)."""
    found = earlier_superset(sets)
    sizes = sets.select(F.col("set_id").alias("earlier"), F.col("n").alias("bits"))
    return found.join(sizes, "earlier", "left").agg(
        F.count(F.lit(1)).alias("sets"),
        F.count("earlier").alias("subsets"),
        F.coalesce(F.sum("bits"), F.lit(0).cast("long")).alias("subset_bits"),
        F.coalesce(F.sum(F.when(F.col("earlier").isNull(), F.col("n"))), F.lit(0).cast("long")).alias("root_elements"),
    )


def kept_supersets(sets: DataFrame) -> DataFrame:
    return earlier_superset(sets).filter("earlier is null").drop("earlier")


def first_compared(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """class_id, plain: of each class the least low whose pair holds. pairs: class_id, sub, super, low, open.

    Open pairs are compared from the least low on, more in each round, for as long as a class has none that holds.
    """
    sure = pairs.filter("not open").groupBy("class_id").agg(F.min("low").alias("sure"))
    nearer = pairs.filter("open").join(sure, "class_id", "left").filter("sure is null or low < sure").drop("sure")
    left = stored(nearer.withColumn("rank", F.row_number().over(Window.partitionBy("class_id").orderBy("low"))), "nearer")
    out, most = sure.withColumnRenamed("sure", "plain"), 1
    while not left.isEmpty():
        found = stored(compared(left.filter(F.col("rank") <= most), distinct).groupBy("class_id").agg(F.min("low").alias("plain")), "first")
        free_shuffles(distinct.sparkSession)
        out, most, done = out.unionByName(found), 8 * most, most
        left = stored(left.filter(F.col("rank") > done).join(found.select("class_id"), "class_id", "left_anti"), "nearer")
    return out.groupBy("class_id").agg(F.min("plain").alias("plain"))


def later_superset(sets: DataFrame, strict: bool = True, accept: Column | None = None) -> DataFrame:
    """set_id, parent_id: the least larger set_id whose set contains this one and (strict) is larger; -1 if there is none.

    accept: what else must hold of sub_n, super_n and sub_max; sets that fail it are passed over.
    """
    copies = copied(sets)
    distinct = classes(sets, copies)
    met = candidates(distinct)
    pairs = (met if accept is None else met.filter(accept)).select(F.col("sub").alias("class_id"), "sub", "super", "sub_n", "super_n", "open")
    members = stored(with_class(sets.select("set_id"), copies).select("class_id", "set_id"), "members")
    # The candidates of a class are its superset classes' members. As-of by id: the next candidate behind each member.
    most = members.groupBy("class_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"))
    spans = stored(pairs.join(most.select(F.col("class_id").alias("super"), "low"), "super").join(most.select("class_id", F.col("high").alias("last")), "class_id"), "spans")
    free_shuffles(sets.sparkSession)
    plain = first_compared(spans.filter("low > last").drop("last"), distinct)  # a class that lies behind all members: its first serves
    mixed = compared(spans.filter("low <= last"), distinct)
    mixed = mixed.join(members.withColumnRenamed("set_id", "candidate").withColumnRenamed("class_id", "super"), "super").select("class_id", "candidate")
    own = members.join(plain, "class_id", "left")
    met = own.join(mixed, "class_id").filter("candidate > set_id").groupBy("set_id").agg(F.min("candidate").alias("mixed"))
    found = own.join(met, "set_id", "left")
    if not strict:
        following = F.lead("set_id").over(Window.partitionBy("class_id").orderBy("set_id"))
        found = found.withColumn("equal", following)
    else:
        found = found.withColumn("equal", F.lit(None).cast("long"))
    least = F.least("plain", "mixed", "equal")
    return found.select("set_id", F.coalesce(least, F.lit(-1).cast("long")).alias("parent_id"))


def latest_in_tree(sets: DataFrame) -> DataFrame:
    """set_id, root, ancestor (both null: a root itself), class_id. root is the first earlier superset, and ancestor the latest
    earlier superset with the same root, or else the root."""
    copies = copied(sets)
    distinct = classes(sets, copies)
    found = stored(with_class(earlier_superset(sets).select("set_id", F.col("earlier").alias("root")), copies).select("class_id", "set_id", "root"), "rooted")
    free_shuffles(sets.sparkSession)
    members = found.filter("root is not null")
    pairs = containments(distinct).select(F.col("sub").alias("class_id"), "super")
    # Of a class, the sets with one root are a run of ids. What ends before a class's run serves all of that run, so that classes
    # meet and not sets; only where runs overlap is the last one before each set looked for.
    spans = members.groupBy("class_id", "root").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"))
    other = spans.select(F.col("class_id").alias("super"), "root", F.col("low").alias("from"), F.col("high").alias("to"))
    met = stored(spans.join(pairs, "class_id").join(other, ["super", "root"]).filter("from < high"), "spans")
    whole = met.filter("to < low").groupBy("class_id", "root").agg(F.max("to").alias("whole"))
    mixed = met.filter("to >= low").select("class_id", "root", "super")
    within = members.select(F.col("class_id").alias("super"), "root", F.col("set_id").alias("candidate"))
    part = members.join(mixed, ["class_id", "root"]).join(within, ["super", "root"]).filter("candidate < set_id").groupBy("set_id").agg(F.max("candidate").alias("part"))
    own = F.lag("set_id").over(Window.partitionBy("class_id", "root").orderBy("set_id"))
    rows = members.withColumn("own", own).join(whole, ["class_id", "root"], "left")
    rows = rows.withColumn("part", F.lit(None).cast("long")) if mixed.isEmpty() else rows.join(part, "set_id", "left")
    rows = rows.select("set_id", "root", F.coalesce(F.greatest("whole", "own", "part"), "root").alias("ancestor"), "class_id")
    return rows.unionByName(found.filter("root is null").select("set_id", "root", F.lit(None).cast("long").alias("ancestor"), "class_id"))


def contiguous_counts(sets: DataFrame) -> DataFrame:
    """One row: sets, and those that are a contiguous part of an earlier one. Met by their first element."""
    copies = copied(sets)
    distinct = classes(sets, copies)
    heads = distinct.filter("n > 0").select(F.col("class_id").alias("sub"), F.col("elems").alias("sub_elems"), F.get("elems", F.lit(0)).alias("elem"))
    big = distinct.select(F.col("class_id").alias("super"), F.col("elems").alias("super_elems"), F.explode("elems").alias("elem"))
    pairs = heads.join(big, "elem").filter((F.col("sub") != F.col("super")) & contains_run(F.col("super_elems"), F.col("sub_elems")))
    least = pairs.groupBy(F.col("sub").alias("class_id")).agg(F.min("super").alias("least"))
    full = distinct.filter("n > 0").agg(F.min("class_id").alias("first_full"))
    rows = with_class(sets, copies).join(least, "class_id", "left").crossJoin(full)  # by one row
    found = F.when(F.col("n") == 0, F.col("first_full") < F.col("set_id")).otherwise(F.least("class_id", F.coalesce("least", "class_id")) < F.col("set_id"))
    return rows.agg(F.count(F.lit(1)).alias("sets"), F.count_if(found).alias("contained"))
