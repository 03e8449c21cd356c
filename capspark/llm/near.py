"""Near-duplicates by an LSH forest over MinHash signatures.

Texts of one shingle set are a class; classes are compared by their representatives. A signature
is read from TREES starting points, each a sorted order. Regions of an order are the runs that
agree on a prefix; the forest looks at prefixes of several depths, and a region that is still large
is entered at a greater depth. Candidates are a class's next neighbours in its region, which share
the longest prefix with it, and the region's centre: the class that sits in the largest regions of
all orders, so a text that many copies were made from meets each of them. These candidates never
grow faster than classes x orders x depths. Links are confirmed on whole shingle sets.

In a crowded region not all classes are candidates of each other. Where the links leave such a
region in more than one component, its classes are completed by a prefix-filter join on whole sets,
so that every pair that shares a crowded region of the least depth is compared or ruled out by its
sets alone. Two estimates remain, both arguments: a pair that shares no region is not seen, and a
candidate of the forest whose signatures are far below the threshold (slack) is not compared. With
exact, all classes are completed as one region and neither matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capspark.llm.session import bound_batches, written
from capspark.llm.shingles import VALUES, set_maker, signer

TREES = 16
DEPTHS = (3, 4, 6, 9, 14, 22)
LARGE = 32
NEIGHBOURS = 3
#: Classes with candidates (24 bytes each) up to which the places of their texts are sent to every
#: task, so that only their texts are shuffled; with more, all texts are shuffled once.
BROADCAST_IDS = 2_000_000
#: How far below the threshold a signature may estimate a candidate of the forest that is still
#: compared: 4 to 6 standard deviations of the share of VALUES equal minima. None compares all.
SLACK = 0.25


def components(links: DataFrame) -> DataFrame:
    """links: a, b (longs). Returns (id, root): the smallest id that each id reaches.

    Large-star and small-star contraction: neighbours are only ever joined to a minimum, no
    neighbourhood is gathered, and each round is written to the shared folder. Loops and repeated
    links do not matter; no links give no rows.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now


def _labels(trees: int):
    """(tree, depth) -> the prefix of that depth which a signature has in that order."""
    step = VALUES // trees
    twice = F.concat("sig", "sig")
    return lambda tree, depth: F.slice(twice, tree * step + 1, depth)


def regions(classes: DataFrame, trees: int = TREES, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """classes: rep, sig. Returns rep, tree, depth, key, c: the regions of more than one class, and
    how many classes they have."""
    label = _labels(trees)
    first = classes.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, label(t, F.lit(depths[0]))).alias("key")))).alias("x")).select("rep", "x.tree", "x.key")
    shared = first.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    inside = first.join(shared, "key", "left_semi").groupBy("rep").agg(F.sort_array(F.collect_set("tree")).alias("trees"))  # at most `trees` for each
    inside = written(inside, "inside").join(classes.select("rep", "sig"), "rep")
    levels = F.flatten(F.transform("trees", lambda t: F.array(*[F.struct(t.alias("tree"), F.lit(d).alias("depth"), F.xxhash64(t, label(t, F.lit(d))).alias("key")) for d in depths])))
    rows = inside.select("rep", F.explode(levels).alias("x")).select("rep", "x.tree", "x.depth", "x.key")
    sizes = rows.groupBy("tree", "depth", "key").agg(F.count("*").alias("c")).filter("c > 1")
    return written(rows.join(sizes, ["tree", "depth", "key"]), "regions")


def candidates(classes: DataFrame, rows: DataFrame, trees: int = TREES, depths: tuple[int, ...] = DEPTHS, neighbours: int = NEIGHBOURS, large: int = LARGE) -> DataFrame:
    """classes: rep, sig; rows: their regions. Returns distinct pairs (a < b) that the forest puts
    together: all of a region of the least depth, unless it is crowded."""
    label = _labels(trees)
    weight = rows.groupBy("rep").agg(F.sum("c").alias("w"))
    weighed = rows.filter("c > 2").join(weight, "rep")
    centres = weighed.groupBy("tree", "depth", "key").agg(F.max(F.struct(F.col("w"), (-F.col("rep")).alias("r"))).alias("m"))
    star = weighed.join(centres, ["tree", "depth", "key"]).select("rep", (-F.col("m.r")).alias("other"))

    of_order = Window.partitionBy("rep", "tree")  # a row for each depth
    entered = F.coalesce(F.min(F.when(F.col("c") <= large, F.col("depth"))).over(of_order), F.max("depth").over(of_order))
    chosen = rows.withColumn("at", entered).filter("depth = at").join(classes.select("rep", "sig"), "rep").withColumn("label", label(F.col("tree"), F.lit(depths[-1])))
    order = Window.partitionBy("tree", "depth", "key").orderBy("label", "rep")
    after = chosen.select("rep", F.array(*[F.lead("rep", k).over(order) for k in range(1, neighbours + 1)]).alias("o")).select("rep", F.explode("o").alias("other")).filter("other is not null")
    pairs = star.unionByName(after).filter("rep <> other")
    return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def crowded(rows: DataFrame, depths: tuple[int, ...] = DEPTHS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """rep, tree, key of the regions of the least depth in which not all pairs are candidates."""
    return rows.filter((F.col("depth") == depths[0]) & (F.col("c") > neighbours + 1)).select("rep", "tree", "key")


def _completion(crowd: DataFrame, near: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """The pairs (a < b) of classes in crowded regions, not in one component of near, that may be
    similar enough: a prefix-filter join, exact on whole sets. None if no region has two components.

    Shingles have one order: those that only one component holds, then the rarer ones. Two sets
    whose first common shingle has fewer shingles behind it, in either, than a link needs in common
    are ruled out. A shingle's largest component is not joined with itself.
    """
    member = crowd.join(near.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = member.groupBy("tree", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("tree", "key")
    apart = written(member.join(mixed, ["tree", "key"], "left_semi").select("rep", "root").distinct(), "apart")
    if apart.isEmpty():
        return None
    own = sets.join(apart, "rep").select("rep", "root", "n", F.explode("shingles").alias("shingle"))
    common = own.groupBy("shingle").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("shingle", "c")
    order = F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("order")
    held = own.join(common, "shingle").groupBy("rep", "root", "n").agg(order).withColumn("k", F.size("order"))
    least = F.expr(f"(n * {percent} + 99) div 100")  # common shingles of any link
    head = held.withColumn("least", least).filter("k >= least").select("rep", "root", "n", "k", F.posexplode(F.slice("order", F.lit(1), (F.col("k") - F.col("least") + 1).cast("int"))).alias("at", "x"))
    head = head.select("rep", "root", "n", "x.shingle", (F.col("k") - F.col("at")).alias("rest"))
    head = head.withColumn("short", F.expr(f"rest * {100 + percent} >= 2 * {percent} * n"))  # enough for a set of its size or more
    head = written(head, "head")

    most = head.groupBy("shingle", "root").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots"))
    head = written(head.join(most.filter("roots > 1").select("shingle", F.col("m.root").alias("most")), "shingle"), "met")
    light = F.col("root") != F.col("most")

    def met(longer: DataFrame, shorter: DataFrame) -> DataFrame:
        x, y = (d.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "root", "n", "rest")]) for d, side in ((longer, "x"), (shorter, "y")))
        enough = F.expr(f"least(rest_x, rest_y) * {100 + percent} >= {percent} * (n_x + n_y)")
        return x.join(y, "shingle").filter("n_x >= n_y and root_x <> root_y").filter(enough).select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))

    short = head.filter("short")
    return met(head.filter(light), short).unionByName(met(head.filter(~light), short.filter(light))).distinct()


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int, least: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures do not rule out, with the number of equal values."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda e: e))
    pairs = pairs.withColumn("agree", agree).filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return written(pairs.filter(F.col("agree") >= least).select("a", "b", "agree"), "pairs")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Pairs carry a's set to b's."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(f"s_{side}")), side)
    common = F.size(F.array_intersect("s_a", "s_b"))
    sized = pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    links = sized.withColumn("both", common).filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both")))
    return links.select("a", "b")


def _to_hubs(pairs: DataFrame, agree: int) -> DataFrame:
    """Of every class's pairs whose signatures agree that often, the one whose other end has most pairs."""
    ways = pairs.select("a", "b", "agree").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    size = pairs.select(F.explode(F.array("a", "b")).alias("b")).groupBy("b").agg(F.count("*").alias("c"))
    best = F.max(F.struct("c", "agree", (-F.col("b")).alias("r"))).alias("m")
    chosen = ways.filter(F.col("agree") >= agree).join(size, "b").groupBy("a").agg(best).select("a", (-F.col("m.r")).alias("b"))
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _of_one_id(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share an id; none where ids are unique."""
    several = [(F.min(c) < F.max(c)).alias(c) for c in ("n", "d1", "d2")]
    ids = signed.filter("n > 0 and id is not null").groupBy("id").agg(*several).filter("n or d1 or d2").select("id")
    member = signed.filter("n > 0").join(written(ids, "several"), "id", "left_semi").join(reps, ["n", "d1", "d2"]).select("id", "rep").distinct()
    first = member.groupBy("id").agg(F.min("rep").alias("a"))
    return member.join(first, "id").filter("a < rep").select("a", F.col("rep").alias("b"))


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int = TREES,
    depths: tuple[int, ...] = DEPTHS,
    neighbours: int = NEIGHBOURS,
    large: int = LARGE,
    slack: float | None = SLACK,
    exact: bool = False,
) -> DataFrame:
    """For every row: id_col, n_shingles, component_id (the smallest id reachable over links of
    Jaccard similarity of at least threshold, in whole hundredths), kept (id_col is component_id).

    Whole sets are compared in three rounds: each class with its hub, then the candidate pairs whose
    ends are not yet in one component, which no further link could change, then those that the
    completion of crowded regions finds between components. trees orders are read to depths, a class
    meets that many neighbours in a region of at most large classes, and slack bounds what signatures
    may rule out (see the top of this module). exact completes all classes, not crowded regions
    alone: every link is found, whatever the other arguments.

    Shingles are five words of the lower-cased (A-Z) text. Fewer words are one shingle; no words or
    a null text link with nothing. Equal sets always link. Rows that share an id are one document:
    each of their sets is compared and they share a component, but for rows without words. A row with
    a null id takes part by its set, where a row with an id has the same; alone it has a null
    component and is kept. Other columns are left out, whatever their names. An empty table gives no
    rows.
    """
    bound_batches(docs.sparkSession)
    percent = round(threshold * 100)
    place = [F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("of")]
    signed = docs.select(*place, signer()(F.col(text_col)).alias("s"))
    signed = written(signed.select("id", "of", "s.n", "s.d1", "s.d2", "s.sig"), "signed")
    reps = signed.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("id"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    classes = signed.join(reps, ["id", "n", "d1", "d2"]).dropDuplicates(["rep"])
    classes = written(classes.select("rep", "id", "of", "n", "sig"), "classes")

    rows = regions(classes, trees, depths)
    crowd = classes.select("rep", F.lit(0).alias("tree"), F.lit(0).cast("long").alias("key")) if exact else crowded(rows, depths, neighbours)
    least = 0 if slack is None else int((threshold - slack) * VALUES)
    pairs = _agreeing(candidates(classes, rows, trees, depths, neighbours, large), classes, percent, least)

    asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(crowd.select("rep")).distinct()
    ask = written(classes.select("rep", "id", "of").join(asked, "rep", "left_semi"), "ask")
    ask = F.broadcast(ask) if ask.count() <= BROADCAST_IDS else ask.hint("merge")
    texts = docs.select(*place, F.col(text_col).alias("t")).join(ask, ["id", "of"])
    sets = texts.select("rep", set_maker()("t").alias("s")).select("rep", "s.n", "s.shingles").dropDuplicates(["rep"])
    sets = written(sets, "sets")
    hubs = _confirmed(_to_hubs(pairs, int(threshold * VALUES)), sets, percent)
    links = written(hubs.unionByName(_of_one_id(signed, reps.drop("id"))), "links")
    near = written(components(links), "near")
    root_a, root_b = (near.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}")) for side in ("a", "b"))
    apart = pairs.join(root_a, "a", "left").join(root_b, "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    links = links.unionByName(written(_confirmed(apart.select("a", "b"), sets, percent), "links"))
    near = written(components(links), "near")
    more = _completion(crowd, near, sets, percent)
    if more is not None and not (more := written(_confirmed(more, sets, percent), "links")).isEmpty():
        near = written(components(near.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more)), "near")

    own = reps.select("rep", F.col("id").alias("least"))
    rest = near.join(own, near["id"] == own["rep"]).groupBy("root").agg(F.min("least").alias("rest"))  # of each but the root itself
    roots = written(rest.join(own.withColumnRenamed("rep", "root"), "root").select("root", F.least("rest", "least").alias("component")), "roots")
    labels = reps.join(near.withColumnRenamed("id", "of"), F.col("rep") == F.col("of"), "left").withColumn("root", F.coalesce("root", "rep"))
    labels = labels.join(roots, "root", "left").select("n", "d1", "d2", F.coalesce("component", "id").alias("least"))
    out = signed.select("id", "n", "d1", "d2").join(labels, ["n", "d1", "d2"], "left")
    component = F.coalesce("least", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_duplicates does not keep; of rows that share an id one stays,
    the one whose text has the smallest hash (of equal texts whose whole row has), or none, and rows
    with a null id stay. All columns stay as they are."""
    found = written(near_duplicates(docs, threshold, id_col, text_col), "near")
    gone = found.filter("not kept").select(F.col(id_col).alias("__gone")).distinct()
    out = docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    twice = found.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("c")).filter("c > 1")
    if twice.isEmpty():
        return out
    place = F.struct(F.xxhash64(text_col).alias("t"), F.xxhash64(F.to_json(F.struct(*docs.columns))).alias("r"))
    ranked = out.withColumn("__place", place)
    first = ranked.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("__place").alias("__first"))
    one = ranked.join(first, (F.col(id_col) == F.col("__id")) & (F.col("__place") == F.col("__first"))).dropDuplicates([id_col])  # equal rows
    return out.filter(F.col(id_col).isNull()).unionByName(one.select(*docs.columns))
