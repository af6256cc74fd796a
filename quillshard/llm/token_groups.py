"""Exact similarity join of word n-grams with a token-group matrix.

A document's set is its distinct three-word shingles (the whole sequence if it has fewer words). Documents with equal sets
form a class, and only classes go on. Shingles are ordered by their hash. A set of ``n`` must share at least
``ceil(0.9 n)`` shingles with a partner, so any ``c`` of those that both share, the first ones, lie within
the first ``n - ceil(0.9 n) + c`` of either set: this prefix, a fifth of the set, is all that is posted.

1. **Shared prefixes.** Prefix shingles that no other class has in its prefix are dropped. A class that keeps too few of its own can have no
   partner and leaves. The same is then asked of whole sets: how many of a set's shingles occur in another one (its reach) bounds every
   overlap it can have.
2. **Groups.** What is left is sorted by the smallest of its shared shingles under a hash, so that similar sets stand side by side, and cut
   into groups of at most ``GROUP_ROWS`` sets and ``GROUP_TOKENS`` shingles. A group opens for its own members, whose similarities are
   one matrix product. With another hash in each of ``ROUNDS`` rounds, the members of a family meet in ever different groups and
   become one component, however many they are. The last round's groups stay. A group also tells its centre, the shingles that more than half of
   its sets hold, and by which shingles each set that is near differs from it. Groups of one large family have equal centres or similar ones; of these,
   found by equal least hashes, that of most classes takes the others' place.
3. **Matrix.** Between components, each group, now with its next neighbours in the order, stores the union of its members' shared prefix shingles, which is the
   token-group matrix. Only shingles that two components hold count. A class probes it with its rarest shingles, one more than it may miss, of
   which classes of one group probe with equal ones once;
   the groups it meets are bounded by how many of its shingles their union holds, and only those that reach what a pair must
   share open. Their members of other components are passed over where the sizes, the smaller reach or the prefixes rule a pair
   out, and are compared on full sets else.
4. **Centres.** Classes of one centre do not meet in the matrix. What two of them share follows from what either shares with the centre and from
   the differences they have in common, so pairs that need none of these are linked through the class nearest to the centre, and all others
   must have enough differences in common: they meet by their rarest ones.

No pair of different components that could link is left out, pairs of one component are never compared again, and nothing is
collected to the driver. A shingle that a third of all classes share is met rarely: it is among the last that a class
probes with. What grows faster than its input is a family whose members miss the threshold, so stay in many components, and have no common
centre or differ from it all in the same way: its classes are held against each other. In one centre, pairs grow so where changes recur.

Null and blank texts have no shingles and are linked with nothing. Rows without an id are linked with nothing and have a null
component. Rows that share an id and the text are one document; rows that share only the id are separate ones, and each takes its own
component. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshard.llm.common import sized, staged, table, text_batches
from quillshard.llm.components import components, relabelled

SHINGLE = 3
SIMILAR_PERCENT = 90
# The part of a set, beyond what it may miss, in which partners must agree: a tenth and this many.
SURE = 4
ROUNDS = 3
GROUP_ROWS, GROUP_TOKENS = 32, 1 << 20
# A column of the matrix is this many neighbouring groups of the last round, as a power of two.
NEIGHBOURS = 2
# A set is near a centre that shares at least this part of either.
NEAR_PERCENT = 75
# Similar centres are found by any of as many least hashes.
CENTRE_KEYS = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 400_000
GROUPED = "node bigint, cluster bigint, tied bigint, centre string, core bigint, held bigint, apart array<bigint>, shape array<bigint>"
SIGNED = "doc_id bigint, tie int, n_shingles bigint, d1 bigint, d2 bigint, prefix array<bigint>"


class _Hashes(dict):
    """Hashes of the words this worker has seen; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z are lower-cased and nothing else."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    s = h[:n].copy()
    for j in range(1, width):
        s = s * _STEP + h[j : n + j]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x94D049BB133111EB) + np.uint64(2 * width)
    s ^= s >> np.uint64(30)
    return np.unique(s)


def shared_least(n: int) -> int:
    """What a set of ``n`` shares with any partner, at least."""
    return -(-SIMILAR_PERCENT * n // 100)


def agreed(n: int) -> int:
    """Of what it shares, how many shingles a set of ``n`` has in its prefix."""
    return min(shared_least(n), n // 10 + SURE)


def prefix_length(n: int) -> int:
    return n - shared_least(n) + agreed(n)


def _needed(n: Column) -> Column:
    """How many prefix shingles a set of ``n`` has in common with any partner's prefix; the smallest partner decides."""
    smallest = F.ceil(n * SIMILAR_PERCENT / 100)
    return F.least(F.ceil(smallest * SIMILAR_PERCENT / 100), F.floor(smallest / 10) + SURE)


def _near_sizes(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILAR_PERCENT * F.greatest(a, b)


def _enough(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes ``a`` and ``b`` with that much in common are similar."""
    return (100 + SIMILAR_PERCENT) * common >= SIMILAR_PERCENT * (a + b)


def _behind(n: Column) -> Column:
    """By how much a prefix falls short of its set."""
    least = F.ceil(n * SIMILAR_PERCENT / 100)
    return least - F.least(least, F.floor(n / 10) + SURE)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)))


def _digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
    return pa.array(d[:, 0]), pa.array(d[:, 1])


def _sign_batches(batches):
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tie"), pa.array([len(s) for s in sets], pa.int64()), *_digests(sets),
             _lists([s[: prefix_length(len(s))] for s in sets])],
            names=["doc_id", "tie", "n_shingles", "d1", "d2", "prefix"])


def _set_batches(batches):
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*_digests(sets), _lists(sets)], names=["d1", "d2", "shingles"])


def _raw(docs: DataFrame) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), F.hash(docs["text"]).alias("tie"), docs["text"].cast("binary").alias("text"))


def _shared(classes: DataFrame) -> DataFrame:
    """``node, n, tokens`` of classes whose prefix holds as many shingles of other prefixes as a partner takes."""
    posted = classes.select("node", F.explode("prefix").alias("token"))
    twice = posted.groupBy("token").agg(F.count(F.lit(1)).alias("listed")).where(F.col("listed") > 1).select("token")
    own = posted.join(twice, "token").groupBy("node").agg(F.collect_list("token").alias("tokens"))
    return staged(
        own.join(classes.select("node", "n"), "node").where(F.size("tokens") >= _needed(F.col("n"))).select("node", "n", "tokens"), "groups-shared")


def _sets_of(docs: DataFrame, classes: DataFrame, shared: DataFrame) -> DataFrame:
    """``node, shingles`` of the given classes, from the text of one of their documents."""
    wanted = staged(classes.join(shared.select("node"), "node", "left_semi").select("node", "d1", "d2", "first_id"), "groups-wanted")
    n = wanted.count()
    ids = sized(wanted.select(F.col("first_id").alias("doc_id")).distinct(), n)
    found = _raw(docs).join(ids, "doc_id", "left_semi").select("text").mapInArrow(_set_batches, "d1 bigint, d2 bigint, shingles array<bigint>")
    named = found.join(sized(wanted.select("node", "d1", "d2"), n), ["d1", "d2"])
    return staged(named.select("node", "shingles").dropDuplicates(["node"]), "groups-sets")


def _reaching(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """The classes, with ``reach``, whose sets share with others what a partner takes."""
    posted = sets.select("node", F.explode("shingles").alias("token"))
    twice = posted.groupBy("token").agg(F.count(F.lit(1)).alias("listed")).where(F.col("listed") > 1).select("token")
    reach = posted.join(twice, "token").groupBy("node").agg(F.count(F.lit(1)).alias("reach"))
    return staged(shared.join(reach, "node").where(100 * F.col("reach") >= SIMILAR_PERCENT * F.col("n")), "groups-reaching")


def tied_members(sets: list[np.ndarray]) -> list[int]:
    """For each set of a group, the first one of its component within the group."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = np.zeros((len(sets), len(sets)))
    for start in range(0, len(tokens), 1 << 16):
        here = (at >= start) & (at < start + (1 << 16))
        held = np.zeros((len(sets), min(1 << 16, len(tokens) - start)), np.float32)
        held[owner[here], at[here] - start] = 1
        common += held @ held.T
    linked = 100 * common >= SIMILAR_PERCENT * (sizes[:, None] + sizes[None, :] - common)
    first = list(range(len(sets)))
    for i in range(len(sets)):
        for j in np.flatnonzero(linked[i, :i]).tolist():
            a, b = first[i], first[j]
            if a != b:
                first = [min(a, b) if f in (a, b) else f for f in first]
    return first


def centred_members(sets: list[np.ndarray]) -> tuple[np.ndarray, list[int | None], list[np.ndarray | None]]:
    """The centre of a group, and how much each set shares with it and by which shingles it differs; None for sets that are not near."""
    tokens, listed = np.unique(np.concatenate(sets), return_counts=True)
    centre = tokens[2 * listed > len(sets)]
    held = [int(np.isin(s, centre, assume_unique=True).sum()) for s in sets]
    near = [0 < NEAR_PERCENT * max(len(s), len(centre)) <= 100 * h for s, h in zip(sets, held)]
    apart = [np.setxor1d(s, centre, assume_unique=True) if ok else None for s, ok in zip(sets, near)]
    return centre, [h if ok else None for h, ok in zip(held, near)], apart


def _group_batches(batches):
    """Cuts sorted classes into groups and opens each for its own members."""
    part, n = TaskContext.get().partitionId(), 0
    nodes: list[int] = []
    sets: list[np.ndarray] = []
    held = 0

    def group():
        nonlocal n, nodes, sets, held
        first = tied_members(sets)
        centre, shares, apart = centred_members(sets)
        name = xxhash.xxh3_128_hexdigest(centre.tobytes())
        teller = next((i for i, h in enumerate(shares) if h is not None), None)
        out = pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([(part << 40) + n] * len(nodes), pa.int64()), pa.array([nodes[f] for f in first], pa.int64()),
             pa.array([None if h is None else name for h in shares], pa.string()), pa.array([len(centre)] * len(nodes), pa.int64()),
             pa.array(shares, pa.int64()), pa.array(apart, pa.list_(pa.int64())),
             pa.array([centre if i == teller else None for i in range(len(nodes))], pa.list_(pa.int64()))],
            names=["node", "cluster", "tied", "centre", "core", "held", "apart", "shape"])
        n, nodes, sets, held = n + 1, [], [], 0
        return out

    for batch in batches:
        shingles = batch.column("shingles")
        flat, starts = shingles.values.to_numpy(), shingles.offsets.to_numpy()
        for row, node in enumerate(batch.column("node").to_pylist()):
            size = int(starts[row + 1] - starts[row])
            if nodes and (len(nodes) == GROUP_ROWS or held + size > GROUP_TOKENS):
                yield group()
            nodes.append(node)
            sets.append(flat[starts[row] : starts[row + 1]].copy())
            held += size
    if nodes:
        yield group()


def _groups(shared: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """``node, cluster, tied`` of one round, and each class against the centre of its group."""
    key = F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(turn))))
    keyed = shared.select("node", "n", key.alias("key")).join(sets, "node")
    ordered = keyed.repartitionByRange("key", "n", "node").sortWithinPartitions("key", "n", "node")
    return staged(ordered.select("node", "shingles").mapInArrow(_group_batches, GROUPED), f"groups-round{turn}")


def _differences(a: Column, b: Column) -> Column:
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _centres(near: DataFrame) -> DataFrame:
    """``centre, into, size, by, classes``: each centre, the similar one that takes its place, how they differ, and how often the latter is told."""
    liked = staged(near.groupBy("centre").agg(F.count(F.lit(1)).alias("listed"), F.first("shape", ignorenulls=True).alias("shape")), "groups-centres")
    keys = [F.array_min(F.transform("shape", lambda t: F.xxhash64(t, F.lit(turn)))) for turn in range(CENTRE_KEYS)]
    keyed = liked.withColumn("key", F.explode(F.array(*keys)))
    first = keyed.groupBy("key").agg(F.max(F.struct("listed", "centre", "shape")).alias("into"))
    similar = 100 * F.size(F.array_intersect("shape", "into.shape")) >= SIMILAR_PERCENT * F.greatest(F.size("shape"), F.size("into.shape"))
    found = keyed.join(first, "key").where(similar).groupBy("centre").agg(F.max("into").alias("into"))
    moves = liked.join(found, "centre", "left").withColumn("into", F.coalesce("into", F.struct("listed", "centre", "shape")))
    moves = staged(moves.select("centre", "listed", F.col("into.centre").alias("into"), F.size("into.shape").cast("bigint").alias("size"),
                                _differences(F.col("shape"), F.col("into.shape")).alias("by")), "groups-moves")
    return staged(moves.join(moves.groupBy("into").agg(F.sum("listed").alias("classes")), "into").drop("listed"), "groups-into")


def _centred(rounds: DataFrame) -> DataFrame:
    """``node, centre, core, held, apart``: of the centres that a class is near in any round, the one it differs least from, and of such that of most classes."""
    near = rounds.where(F.col("centre").isNotNull())
    told = near.join(_centres(near.select("centre", "shape")), "centre").withColumn("differ", _differences(F.col("apart"), F.col("by")))
    n = F.size("apart") - F.col("core") + 2 * F.col("held")
    told = told.withColumn("shares", F.shiftright(n + F.col("size") - F.size("differ"), 1))
    best = F.max_by(F.struct(F.col("into").alias("centre"), F.col("size").alias("core"), F.col("shares").alias("held"), F.col("differ").alias("apart")),
                    F.struct(-F.size("differ"), "classes", "into"))
    return staged(told.groupBy("node").agg(best.alias("best")).select("node", "best.*"), "groups-centred")


def _one_centre(family: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of different components among the classes ``node, comp, n`` of each centre, as far as links need them.

    Two sets share what either shares with the centre, less the centre's size, and the differences they have in common. So
    with ``near`` as below, they are linked if their ``near`` and ``unit`` for each common difference come to 0 or more. If that holds for a pair
    without any, it holds for either of them and the class with the largest ``near`` too: they are paired with that one, the others with each other.
    """
    unit = 2 * (100 + SIMILAR_PERCENT)
    near = unit * F.col("held") - 2 * SIMILAR_PERCENT * F.col("n") - (100 + SIMILAR_PERCENT) * F.col("core")
    family = family.withColumn("near", near)
    tops = staged(family.groupBy("centre").agg(F.max(F.struct("near", "node", "comp")).alias("top")), "groups-tops")
    n = tops.count()
    marked = family.join(sized(tops, n), "centre").withColumn("by_top", F.col("near") + F.col("top.near") >= 0)
    outer = marked.where(~F.col("by_top")).groupBy("centre").agg(F.max("near").alias("most"))
    to_top = marked.where(F.col("by_top") & (F.col("comp") != F.col("top.comp"))).select(F.col("top.node").alias("a"), F.col("node").alias("b"))

    def least(other: Column) -> Column:
        return F.ceil(-(F.col("near") + other) / unit)

    marked = marked.join(sized(outer, n), "centre").select(
        "centre", "node", "comp", "n", "by_top", "apart", least(F.col("most")).alias("need"), least(F.col("top.near")).alias("need_top"))
    posted = marked.select("centre", "node", "by_top", F.explode("apart").alias("token"))
    several = posted.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("listed"), F.count_if(~F.col("by_top")).alias("outer")).where(
        (F.col("listed") > 1) & (F.col("outer") > 0)).select("centre", "token", "listed")
    common = posted.join(several, ["centre", "token"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("listed", "token"))).alias("own"))
    asking = staged(marked.drop("apart").join(common, "node").withColumn("tokens", F.col("own.token")).drop("own"), "groups-apart")

    def probes(rows: DataFrame, need: str) -> DataFrame:
        first = F.slice("tokens", F.lit(1), (F.size("tokens") - F.col(need) + 1).cast("int"))
        return rows.where(F.size("tokens") >= F.col(need)).select("centre", "node", "comp", "n", F.explode(first).alias("token"))

    inner, outer = asking.where(F.col("by_top")), asking.where(~F.col("by_top"))
    other = probes(outer, "need").select("centre", "token", *[F.col(c).alias(f"other_{c}") for c in ("node", "comp", "n")])
    longer = probes(outer, "need_top").select("centre", "token", *[F.col(c).alias(f"other_{c}") for c in ("node", "comp", "n")])
    fits = (F.col("comp") != F.col("other_comp")) & _near_sizes(F.col("n"), F.col("other_n"))
    met = [(probes(inner, "need"), longer, fits), (probes(outer, "need"), other, fits & (F.col("node") < F.col("other_node")))]
    pairs = to_top
    for one, two, rule in met:
        both = one.join(two.withColumnsRenamed({"centre": "of", "token": "by"}), (F.col("centre") == F.col("of")) & (F.col("token") == F.col("by")) & rule)
        pairs = pairs.union(both.select(F.col("node").alias("a"), F.col("other_node").alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rarest() -> Column:
    """The shingles that a class probes with: of these, any partner's column holds one."""
    return F.slice("tokens", F.lit(1), (F.size("tokens") - F.col("need") + 1).cast("int"))


def _met(asking: DataFrame, held: DataFrame) -> DataFrame:
    """``asker, cluster, met``: columns and the rare shingles they meet by, each asked for once however many members probe with it."""
    probes = asking.select(F.col("cluster").alias("asker"), F.explode(_rarest()).alias("token")).distinct()
    cells = held.select("cluster", F.explode("union").alias("token"))
    return probes.join(cells, "token").groupBy("asker", "cluster").agg(F.collect_list("token").alias("met"))


def _same_centre(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) == F.col(b), F.lit(False))


def _open(shared: DataFrame, groups: DataFrame, labels: DataFrame, centred: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of different components that neither the matrix nor their common centre rules out."""
    wider = groups.select("node", F.shiftright("cluster", NEIGHBOURS).alias("cluster"))
    members = shared.join(wider, "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    posted = members.select("node", "comp", F.explode("tokens").alias("token"))
    several = posted.groupBy("token").agg(F.count(F.lit(1)).alias("listed"), F.min("comp").alias("low"), F.max("comp").alias("high")).where(
        F.col("low") < F.col("high")).select("token", "listed")
    across = posted.join(several, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("listed", "token"))).alias("own"))
    asking = members.drop("tokens").join(across, "node").withColumn("need", _needed(F.col("n"))).where(F.size("own") >= F.col("need"))
    asking = asking.withColumn("tokens", F.col("own.token")).join(centred.select("node", "centre"), "node", "left")
    asking = staged(asking, "groups-asking")
    held = asking.groupBy("cluster").agg(
        F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.when((F.count("centre") == F.count(F.lit(1))) & (F.min("centre") == F.max("centre")), F.min("centre")).alias("only"))
    held = staged(held, "groups-matrix")
    met = _met(asking, held).join(held, "cluster")
    fits = (100 * F.col("most") >= SIMILAR_PERCENT * F.col("n")) & (100 * F.col("n") >= SIMILAR_PERCENT * F.col("least"))
    fits &= _enough(F.col("reach"), F.col("n"), F.greatest(F.col("least"), F.ceil(F.col("n") * SIMILAR_PERCENT / 100)))
    other = ((F.col("low") < F.col("high")) | (F.col("low") != F.col("comp"))) & ~_same_centre("only", "centre")
    holds = F.when(F.arrays_overlap("rarest", "met"), F.size(F.array_intersect("tokens", "union")) >= F.col("need")).otherwise(False)
    own = asking.select(F.col("cluster").alias("asker"), "node", "tokens", "need", "n", "reach", "comp", "centre", _rarest().alias("rarest"))
    shown = ("node", "n", "reach", "comp", "centre", "tokens")
    bounded = own.join(met, "asker").where(F.when(fits & other, holds).otherwise(False)).select("cluster", *shown)
    partners = asking.select(F.col("cluster").alias("of"), *[F.col(c).alias(f"other_{c}") for c in shown])
    n, m = F.col("n"), F.col("other_n")
    cheap = (F.col("comp") != F.col("other_comp")) & ~_same_centre("centre", "other_centre") & _near_sizes(n, m) & _enough(F.least("reach", "other_reach"), n, m)
    # of what they share, both prefixes hold all but what the prefix that falls shorter may leave out
    prefixes = _enough(F.size(F.array_intersect("tokens", "other_tokens")) + F.greatest(_behind(n), _behind(m)), n, m)
    opened = bounded.join(partners, (F.col("cluster") == F.col("of")) & F.when(cheap, prefixes).otherwise(False)).withColumnRenamed("other_node", "other")
    opened = opened.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    return opened.union(_one_centre(asking.select("node", "comp", "n").join(centred, "node")))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return both.where(100 * common >= SIMILAR_PERCENT * (F.size("xa") + F.size("xb") - common)).select("a", "b")


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, tie, n_shingles, component_id`` per row; ``tie`` is the hash of the text."""
    signed = staged(_raw(docs).mapInArrow(_sign_batches, SIGNED), "groups-signed")
    grouped = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("d1", "d2").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"))
    classes = staged(grouped.withColumn("node", F.monotonically_increasing_id()), "groups-classes")
    shared = _shared(classes)
    sets = _sets_of(docs, classes, shared)
    shared = _reaching(shared, sets)
    rounds = [_groups(shared, sets, turn) for turn in range(ROUNDS)]
    ties = rounds[0]
    for r in rounds[1:]:
        ties = ties.unionByName(r)
    labels = components(ties.where(F.col("node") != F.col("tied")).select(F.col("tied").alias("a"), F.col("node").alias("b")))
    fresh = staged(_confirmed(_open(shared, rounds[-1], labels, _centred(ties)), sets), "groups-links")
    if not fresh.isEmpty():
        labels = relabelled(labels, fresh)
    linked = classes.select("node", "d1", "d2", "first_id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = linked.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = signed.drop("prefix").join(linked.join(smallest, "comp").select("d1", "d2", "component_id"), ["d1", "d2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "tie", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def op11_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).drop("tie")


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END) AS k
  FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS other FROM both_ways
  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest USING (doc_id)
"""
