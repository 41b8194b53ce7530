"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct word shingles; equal sets are one class.
A class has a signature of minwise tokens.  A tree is a recursion over nodes of
classes: a node chooses one or two places of the signature by its own path
(1 / similarity of them on average), and a class goes on to the children named
by its tokens there.  Similar classes share a leaf of a tree with a probability
that hardly falls with the depth; independent trees bring it near one.  Small
nodes are compared exhaustively, by signature first and then on the full sets;
the classes of large ones by a join of the rarest shingles of their sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speccurve.llm.common import ship
from speccurve.llm.common import dropped, maybe_broadcast, stored
from speccurve.llm.links import components, extended

PLACES = 96
TREES = 12
# Levels that every class goes down before nodes are counted.
DEPTH = 3
# Largest node compared exhaustively.
NODE = 64
# Agreement of signatures, in standard deviations below the similarity, from
# which classes are compared further.
SLACK = 4.9
# Places of the longer sketch, one byte each, by which members of a node are
# compared, and how many of them choose a class's best partner.
SKETCH = 768
FIRST = 128

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACES = "\t\n\x0b\x0c\r"


def shingle_sets(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, h: the distinct hashes of runs of ``size`` words of the whole text,
    or of all words if there are fewer."""
    plain = F.translate(
        F.coalesce(F.col(text), F.lit("")), _UPPER + _SPACES, _UPPER.lower() + " " * len(_SPACES)
    )
    words = df.select(
        F.col(key).alias("key"), F.array_remove(F.split(plain, " "), "").alias("w")
    )

    def run(word: Column, at: Column) -> Column:
        return F.xxhash64(F.lit(size), word, *[F.get("w", at + k) for k in range(1, size)])

    runs = F.slice(F.transform("w", run), F.lit(1), F.size("w") - (size - 1))
    short = F.array(F.xxhash64(F.lit(-1), F.concat_ws(" ", "w")))
    return words.select(
        "key",
        F.when(F.size("w") >= size, F.array_distinct(runs))
        .when(F.size("w") > 0, short)
        .otherwise(F.array().cast("array<bigint>"))
        .alias("h"),
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A good scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeds(n: int, salt: int) -> np.ndarray:
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(salt))


_FACTORS = _seeds(SKETCH, 1) | np.uint64(1)
_SHIFTS = _seeds(SKETCH, 2)


def signature(h: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The least 32-bit hash of a set for each of ``places`` (SKETCH at most)."""
    out = np.full(places, 0xFFFFFFFF, np.uint64)
    for lo in range(0, len(h), 1024):
        part = h[lo : lo + 1024, None] * _FACTORS[:places] + _SHIFTS[:places]
        out = np.minimum(out, (part >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def signed_sets(sets: DataFrame, places: int = PLACES) -> DataFrame:
    """key, n_shingles, two hashes of the whole set, signature, for (key, h)."""
    ship(sets.sparkSession)
    salts = _seeds(2, 3)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = part.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
                at = at.astype(np.int64)
                sums = np.zeros((2, part.num_rows), np.uint64)
                filled = np.flatnonzero(at[1:] > at[:-1])
                for k in range(2):
                    if len(filled):
                        sums[k, filled] = np.add.reduceat(mix(flat ^ salts[k]), at[filled])
                signs = [signature(flat[lo:hi], places).tobytes() for lo, hi in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(at[1:] - at[:-1]), pa.array(sums[0].view(np.int64)),
                     pa.array(sums[1].view(np.int64)), pa.array(signs, pa.binary())],
                    names=["key", "n_shingles", "s1", "s2", "sign"],
                )

    key_type = sets.schema["key"].dataType.simpleString()
    return sets.mapInArrow(
        run, f"key {key_type}, n_shingles long, s1 long, s2 long, sign binary"
    )


def grow(path: np.ndarray, who: np.ndarray, signs: np.ndarray, share: float):
    """One level: paths of the children, and who goes there.

    A node chooses a second place with probability 1 / ``share`` - 1.
    """
    places = np.uint64(signs.shape[1])
    first = mix(path ^ np.uint64(0xA5)) % places
    second = (mix(path ^ np.uint64(0x5A)) >> np.uint64(11)).astype(float) / 2.0**53
    more = second < 1 / share - 1
    other = mix(path[more] ^ np.uint64(0xC3)) % places
    path, who = np.r_[path, path[more]], np.r_[who, who[more]]
    place = np.r_[first, other]
    token = signs[who, place.astype(np.int64)].astype(np.uint64)
    return mix(mix(path + place) ^ token), who


def _descend(rows: DataFrame, levels: int, share: float, trees: int | None) -> DataFrame:
    """path, rep after ``levels`` more levels; from the roots of ``trees``, or
    from the column ``path``."""
    ship(rows.sparkSession)
    roots = _seeds(trees or 1, 4)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                n = part.num_rows
                if not n:
                    continue
                signs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32)
                signs = signs.reshape(n, -1)
                if trees is None:
                    path, who = part.column(2).to_numpy().view(np.uint64), np.arange(n)
                else:
                    path, who = np.repeat(roots, n), np.tile(np.arange(n), trees)
                for _ in range(levels):
                    path, who = grow(path, who, signs, share)
                order = np.lexsort((path, who))  # both places can be the same one
                path, who = path[order], who[order]
                new = np.r_[True, (path[1:] != path[:-1]) | (who[1:] != who[:-1])]
                path, who = path[new], who[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path.view(np.int64)), part.column(0).take(pa.array(who))],
                    names=["path", "rep"],
                )

    key_type = rows.schema["rep"].dataType.simpleString()
    columns = ["rep", "sign"] + (["path"] if trees is None else [])
    return rows.select(*columns).mapInArrow(run, f"path long, rep {key_type}")


def _sketched(sets: DataFrame, places: int) -> DataFrame:
    """rep, sketch: one byte of the least hash for each of ``places`` (SKETCH at most)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            at = at.astype(np.int64)
            sketches = [
                signature(flat[lo:hi], places).astype(np.uint8).tobytes()
                for lo, hi in zip(at[:-1], at[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sketches, pa.binary())], names=["rep", "sketch"]
            )

    kind = sets.schema["key"].dataType.simpleString()
    return sets.select("key", "h").mapInArrow(run, f"rep {kind}, sketch binary")


def _compare(rows: DataFrame, share: float, own_only: bool) -> DataFrame:
    """path, a, b, agree: classes in a node that are not in one component yet
    and may be similar.

    ``rows`` (path, rep, component, sketch, pivot, distance, nodes) hold nodes
    of bounded size.  Excluded are pairs whose sketches agree too
    little, and pairs of one pivot whose distances to it differ by more than a
    link's distance (Jaccard distance is a metric).  A pair of several nodes is
    compared in the first of them; ``nodes`` are the nodes of a class.  With ``own_only`` each class offers only its best partner of the node.
    """
    ship(rows.sparkSession)
    apart = 1 - share + 1e-9

    def pairs(reps, parts, sketches, pivots, distances, _nodes):
        places = len(sketches[0])
        least = share - SLACK * (share * (1 - share) / places) ** 0.5
        sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(reps), -1)
        parts = np.array(parts)
        pivots = np.array(pivots, object)
        distances = np.array([np.nan if d is None else d for d in distances])
        for i in range(len(reps)):
            # A class's best partner may stand before it; other pairs are seen once.
            at = 0 if own_only else i + 1
            same = (sketches[at:] == sketches[i]).mean(axis=1)
            agree = (same - 1 / 256) / (1 - 1 / 256)
            far = (pivots[at:] == pivots[i]) & (np.abs(distances[at:] - distances[i]) > apart)
            fits = (agree >= least) & ~far & (parts[at:] != parts[i])
            if own_only:
                if fits.any():
                    k = int(np.argmax(np.where(fits, agree, -1.0)))
                    yield min(i, k), max(i, k), float(agree[k])
                continue
            for k in np.flatnonzero(fits).tolist():
                yield i, at + k, float(agree[k])

    def run(batches):
        def node(own, members):
            found = list(pairs(*zip(*members)))
            if own_only:
                found = sorted(set(found))
            else:
                nodes = [frozenset(m[-1]) for m in members]
                found = [x for x in found if min(nodes[x[0]] & nodes[x[1]]) == own]
            for i, k, agree in found:
                a, b = sorted((members[i][0], members[k][0]))
                for column, value in zip(out, (at, a, b, agree), strict=True):
                    column.append(value)

        out, held, at = ([], [], [], []), [], None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for path, *member in zip(*columns, strict=True):
                if path != at:
                    if len(held) > 1:
                        node(at, held)
                    held, at = [], path
                held.append(member)
            if out[0]:
                yield _pairs_batch(out, key_arrow)
                out = ([], [], [], [])
        if len(held) > 1:
            node(at, held)
        if out[0]:
            yield _pairs_batch(out, key_arrow)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["rep"].dataType
    key_arrow = to_arrow_type(kind)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.select("path", "rep", "component", "sketch", "pivot", "distance", "nodes")
        .repartition(n, "path").sortWithinPartitions("path", "rep")
        .mapInArrow(
            run, f"path long, a {kind.simpleString()}, b {kind.simpleString()}, agree double"
        )
    )


def _pairs_batch(out, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.int64()), pa.array(out[1], kind), pa.array(out[2], kind),
         pa.array(out[3], pa.float64())],
        names=["path", "a", "b", "agree"],
    )


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, distance, fits of every pair, from the full sets; fits: 100 *
    intersection >= percent * union."""
    left = sets.select(F.col("key").alias("a"), F.col("h").alias("ha"))
    right = sets.select(F.col("key").alias("b"), F.col("h").alias("hb"))
    met = pairs.join(left, "a").join(right, "b").select(
        "a", "b", F.size(F.array_intersect("ha", "hb")).cast("long").alias("both"),
        (F.size("ha") + F.size("hb")).cast("long").alias("sum"),
    )
    union = F.col("sum") - F.col("both")
    return met.select(
        "a", "b", (1 - F.col("both") / union).alias("distance"),
        (100 * F.col("both") >= percent * union).alias("fits"),
    )


def _ends(pairs: DataFrame) -> DataFrame:
    """The classes of pairs, once each."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    return stored(ends, "ends")


def _relabelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` with the component of each rep, itself where it has no link."""
    return rows.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of nodes with several components, with the size of the node."""
    nodes = rows.groupBy("path").agg(
        F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    return rows.join(nodes.where("lo <> hi").select("path", "size"), "path")


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = 80,
    trees: int = TREES,
) -> DataFrame:
    """key, n_shingles, component for every document.

    Documents are linked if their sets of ``shingle``-word runs (lower-cased
    A-Z; all words of a shorter text are one run) have 100 * intersection >=
    ``percent`` * union; ``component`` is the smallest key reachable.  No words
    or a null text: an empty set, linked with nothing.  Equal texts are linked.
    Rows with a null key take no part (component null); rows that repeat a key
    all count, under that key.  Other columns are ignored; an empty table gives
    no rows.

    What is shuffled: signatures of classes (``PLACES`` 32-bit numbers), paths,
    and the sets of classes that share a node.  Links found early contract the
    classes: nodes within one component are done, so a large group of near
    copies costs some links per class and not all pairs.
    """
    share = percent / 100
    named = df.where(F.col(key).isNotNull())
    signed = stored(signed_sets(shingle_sets(named, key, text, shingle)), "signatures")
    classes = set_classes(signed)
    # A repeated key with different texts is one node of the graph with several sets.
    members = shared_nodes(_descend(classes, DEPTH, share, trees))

    def sets_of(reps: DataFrame) -> DataFrame:
        ids = maybe_broadcast(reps.withColumnRenamed("rep", key), reps.count(), 16)
        return shingle_sets(named.join(ids, key, "left_semi"), key, text, shingle)

    comps = linked(members, classes, sets_of, percent)

    label = comps.select(F.col("node").alias("rep"), "component")
    of_class = classes.select("s1", "s2", "n_shingles", "rep").join(label, "rep", "left").select(
        "s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component")
    )
    placed = signed.join(of_class, ["s1", "s2", "n_shingles"], "left").select(
        F.col("key").alias(key), "n_shingles", F.coalesce("component", "key").alias("component")
    )
    nameless = shingle_sets(df.where(F.col(key).isNull()), key, text, shingle).select(
        F.col("key").alias(key), F.size("h").cast("long").alias("n_shingles"),
        F.col("key").alias("component"),
    )
    return placed.union(nameless)


def set_classes(signed: DataFrame) -> DataFrame:
    """s1, s2, n_shingles, rep, sign of every class of equal sets that are not
    empty; its rep is the smallest key."""
    first = (
        signed.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles")
        .agg(F.min(F.struct("key", "sign")).alias("x"))
    )
    return stored(
        first.select(
            "s1", "s2", "n_shingles", F.col("x.key").alias("rep"), F.col("x.sign").alias("sign")
        ),
        "classes",
    )


def shared_nodes(leaves: DataFrame) -> DataFrame:
    """path, rep, pivot of the nodes with several classes; pivot is the first of them."""
    leaves = stored(leaves, "leaves")
    nodes = leaves.groupBy("path").agg(F.count("*").alias("size"), F.min("rep").alias("pivot"))
    members = stored(
        leaves.join(nodes.where("size > 1"), "path").select("path", "rep", "pivot"), "members"
    )
    dropped(leaves)
    return members


def linked(
    members: DataFrame,
    classes: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    percent: int,
    places: int = PLACES,
    sketch: int = SKETCH,
) -> DataFrame:
    """node, component of the classes linked with any other: similar classes
    that share a node of ``members`` (path, rep, pivot).

    ``classes`` has n_shingles and the signature (sign) of each rep; ``sets_of``
    gives the full sets (key, h) of a table of reps.  Every link is confirmed on
    full sets, and no pair of a node is lost.  ``sketch`` is the length of the
    sketches: a shorter one lets more pairs through to the full sets.
    """
    share = percent / 100
    least = share - SLACK * (share * (1 - share) / places) ** 0.5
    signs = classes.select("rep", "sign")
    # Every class against the first of its nodes; the best agreement is confirmed.
    stars = members.where("rep <> pivot").select("rep", "pivot").distinct()
    best = stored(
        stars.join(signs, "rep")
        .join(signs.select(F.col("rep").alias("pivot"), F.col("sign").alias("other")), "pivot")
        .select("rep", "pivot", _agreement("sign", "other").alias("agree"))
        .where(F.col("agree") >= least)
        .groupBy("rep").agg(F.max(F.struct("agree", "pivot")).alias("x"))
        .select(F.col("x.pivot").alias("a"), F.col("rep").alias("b")),
        "stars",
    )
    sets = stored(sets_of(_ends(best)), "sets")
    measured = stored(_measured(best, sets, percent), "measured")
    dropped(sets)
    links = measured.where("fits").select("a", "b")
    comps = components(links)

    # What is left is compared within nodes of several components.
    rows = stored(
        _mixed(_relabelled(members.select("path", "rep"), comps)).select("path", "rep", "size"),
        "nodes",
    )
    small = stored(rows.where(F.col("size") <= NODE).select("path", "rep"), "small")
    reps = stored(small.select("rep").distinct(), "ends")
    sets = stored(sets_of(reps), "sets")
    sketches = stored(_sketched(sets, sketch), "sketches")
    pivots = measured.select(F.col("b").alias("rep"), F.col("a").alias("pivot"), "distance")

    def nodes_with(sketch: Column) -> DataFrame:
        rows = stored(_mixed(_relabelled(small, comps)).drop("size"), "mixed")
        nodes_of = rows.groupBy("rep").agg(F.collect_set("path").alias("nodes"))
        return (
            rows.join(sketches.withColumn("sketch", sketch), "rep")
            .join(pivots, "rep", "left").join(nodes_of, "rep")
        )

    def confirmed(pairs: DataFrame, sets: DataFrame, n_sets: int) -> DataFrame:
        ends = maybe_broadcast(_ends(pairs).withColumnRenamed("rep", "key"), n_sets, 16)
        own = sets.join(ends, "key", "left_semi")
        return stored(_measured(pairs, own, percent).where("fits").select("a", "b"), "links")

    # First the best partner in another component of every class.
    n_reps = reps.count()
    first = nodes_with(F.substring("sketch", 1, FIRST))
    offers = stored(_compare(first, share, True), "offers")
    partner = F.max(F.struct("agree", F.col("a").alias("x"), F.col("b").alias("y"))).alias("best")
    pairs = (
        offers.select("*", F.explode(F.array("a", "b")).alias("rep"))
        .groupBy("rep").agg(partner).select(F.col("best.x").alias("a"), F.col("best.y").alias("b"))
        .distinct()
    )
    comps = extended(comps, confirmed(stored(pairs, "pairs"), sets, n_reps))
    # Then all partners, of the classes that had one to offer in a node.
    met = offers.select("path", F.explode(F.array("a", "b")).alias("rep")).distinct()
    every = small
    small = stored(every.join(met, ["path", "rep"], "left_semi"), "small")
    dropped(every)
    dropped(offers)
    pairs = stored(_compare(nodes_with(F.col("sketch")), share, False).select("a", "b"), "pairs")
    for table in (small, sketches, measured, best):
        dropped(table)
    comps = extended(comps, confirmed(pairs, sets, n_reps))
    dropped(sets)
    dropped(pairs)

    large = rows.where(F.col("size") > NODE).select("path", "rep")
    reps = stored(
        _mixed(_relabelled(large, comps)).select("rep", "component").distinct(), "ends"
    )
    if reps.isEmpty():
        return comps
    sets = stored(sets_of(reps.select("rep")), "sets")
    pairs = stored(_rarest_in_common(sets, reps, percent), "pairs")
    comps = extended(comps, confirmed(pairs, sets, reps.count()))
    dropped(sets)
    return comps


def _rarest_in_common(sets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of classes of different components (``reps``: rep, component)
    that may be linked, by a prefix-filtered join of their ``sets`` (key, h).

    Shingles are ordered by how many sets have them.  Two sets of sizes x <= y
    with a similarity of t share 2 t / (1 + t) x shingles at least, and t y; so
    they share one of the first x - 2 t / (1 + t) x + 1 of the one and of the
    first y - t y + 1 of the other.  A class beside a large group of near copies
    that is not linked with it lacks more than that of their shingles and has as
    many of its own, which are rare; so the group's shingles are in no prefix of
    another component, and are dropped before anything is joined.
    """
    sized = sets.join(reps.withColumnRenamed("rep", "key"), "key").select(
        # A repeated key may have several sets.
        F.monotonically_increasing_id().alias("set"), "key", "component",
        F.size("h").cast("long").alias("n"), "h",
    )
    several = stored(
        sized.select("component", F.explode("h").alias("h")).groupBy("h").agg(
            F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")
        ).where("lo <> hi").select("h", "df"),
        "several",
    )
    # What one component alone has comes first and meets nothing: only its number counts.
    ranked = (
        sized.select("set", "key", "component", "n", F.explode("h").alias("h"))
        .join(maybe_broadcast(several, several.count(), 16), "h")
        .groupBy("set", "key", "component", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("t"))
    )
    alone = F.col("n") - F.size("t")
    n, two = F.col("n"), 2 * percent
    # In whole numbers: n - ceil(need) + 1.
    short = n - F.expr(f"({two} * n + {99 + percent}) div {100 + percent}") + 1
    long = n - F.expr(f"({percent} * n + 99) div 100") + 1
    first = F.slice("t", F.lit(1), F.greatest(long - alone, F.lit(0)).cast("int"))
    placed = ranked.select(
        "key", "component", "n", F.posexplode(first).alias("at", "token"), alone.alias("alone"),
        short.alias("short"),
    ).select(
        "key", "component", "n", "token.h", (F.col("alone") + F.col("at")).alias("at"),
        (F.col("alone") + F.col("at") < F.col("short")).alias("short"),
    )
    placed = stored(placed, "prefixes")
    mixed = stored(
        placed.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi").select("h"),
        "mixed",
    )
    own = stored(placed.join(maybe_broadcast(mixed, mixed.count(), 16), "h"), "prefixes")
    left = (F.col("n") - F.col("at")).alias("left")
    one = own.where("short").select("h", "key", "component", "n", left).toDF(
        "h", "x", "cx", "nx", "lx"
    )
    other = own.select("h", "key", "component", "n", left).toDF("h", "y", "cy", "ny", "ly")
    # The first shingle in common leaves enough behind it on both sides.
    fits = (
        (F.col("cx") != F.col("cy")) & (100 * F.col("nx") >= percent * F.col("ny"))
        & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))))
        & ((100 + percent) * F.least("lx", "ly") >= percent * (F.col("nx") + F.col("ny")))
    )
    return one.join(other, "h").where(fits).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    ).distinct()


def _agreement(one: str, other: str) -> Column:
    """Share of equal places of two binary signatures, in columns only."""
    at = F.sequence(F.lit(1), F.octet_length(one), F.lit(4))
    same = F.filter(
        at, lambda i: F.substring(F.col(one), i, F.lit(4)) == F.substring(F.col(other), i, F.lit(4))
    )
    return 4 * F.size(same) / F.octet_length(one)
