"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its hashed word shingles. Hashing the shingles into groups makes it a point, the vector of
its group counts, and the summed minima of two points' coordinates bound the overlap of the sets. The points are kept
in an R-tree in two storeys.

The upper storey makes tiles. Two sets that link differ in at most D shingles, so of m > D groups at least m - D hold
the same shingles in both. Sizes fall into classes as wide as the threshold allows, each class has its own m, and a
set goes to the tile (class, group, content of the group) of each of its groups, for its own class and the next. Sets
that link share a tile, unless all groups they share are empty; sets with that many empty groups share one tile of
their class. So tiles lose no link, their number follows the input, and a passage that many documents share fills no
group by itself. Tiles are read as a stream of sorted rows, each content is kept once, and in a tile the points'
summed minima decide which sets belong to one family; a very large tile is one family. No rows are made for pairs.

The lower storey is built within families. A family of more than a leaf is packed into leaves by size class, then
coordinates (sort-tile-recursive), and sixteen neighbouring nodes make a node of the next level, up to one root. A
node keeps its smallest and largest size, the largest coordinates in it, whose summed minima bound all overlaps with
another node, and the range of components found so far. First each leaf meets itself and the next one, where most of
what is alike connects; then leaves are packed anew by those components, and pairs of nodes descend from the root,
level by level, by joins on the parents: pairs that the sizes or the bound rule out, and pairs whose sets are all one
component already, go no further. So a family of near copies of each other, however large, ends at its root, and no
key holds more than a node's children. What is left at the leaves is met by the points' own minima, and surviving
pairs are verified on the sets; pairs already connected are skipped, and a pair of leaves returns a spanning forest,
so rows stay linear in the sets. Families too large for one leaf go through this by the bound alone first, which
splits them into the parts that it connects, then by their sets. Leaves are bounded by the sets' number and bytes.
Components of the verified links come from distributed rounds.

Identical sets are one point throughout, so exact copies cost nothing. Shingles are compared by 64-bit hashes. A null
or empty text, or one without words, has an empty set, links with nothing and is its own component; a text with fewer
words than a shingle has one shingle, the whole sequence. A null doc_id is kept and never names a component with
other ids. Rows that repeat a doc_id are nodes by their sets. Very long texts are one set each, whole. Empty tables
give no rows. Other columns are ignored by ngram_components and kept by one_of_each, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NONE, Forest, components, contracted, drop_paths, hide_null, lowered, materialize, mix64, ship, show_null, with_rows

_WORDS = re.compile("[^\x20\x09-\x0d]+")
DIMS = 64
#: Sets in a tile that is looked at by itself.
TILE = 4096
#: Sets in a leaf; a set of more than LONG shingles counts as several.
LEAF = 256
LONG = 8192
#: The binary logarithm of a node's children.
FAN = 4


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = _WORDS.findall(lowered(text or ""))
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[str, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


@functools.lru_cache(maxsize=8)
def size_classes(num: int, den: int, upto: int = 2**26) -> np.ndarray:
    """First sizes of the classes: sets that link lie in one class or in neighbouring ones."""
    at = [1]
    while at[-1] <= upto:
        at.append(at[-1] * den // num + 1)
    return np.array(at, np.int64)


@functools.lru_cache(maxsize=None)
def groups_of(cls: int, num: int, den: int) -> tuple[int, int]:
    """The number of groups for links whose larger set is in cls, and of them the spare ones."""
    starts = size_classes(num, den)
    most, least = int(starts[cls + 1]) - 1, int(starts[max(cls - 1, 0)])
    d = 2 * most * (den - num) // (den + num)
    if not d:
        return 0, 0
    spare = 2
    for _ in range(20):  # the smallest sets of the class leave most groups empty: nearly all have no more than the spare
        m = d + 1 + spare
        empty = m * np.exp(-least / m)
        spare = int(empty + 4 * np.sqrt(empty)) + 2
    return d + 1 + spare, spare


def tile_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the tiles of a set, by class, group and the group's content."""
    own = int(np.searchsorted(size_classes(num, den), len(s), side="right")) - 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(s))])
    out = []
    for cls in (own, own + 1):
        m, spare = groups_of(cls, num, den)
        if not m:
            continue
        # equal shares of the hash range: the sorted set falls into runs
        edges = (np.arange(m + 1, dtype=np.float64) * (2.0**64 / m))[1:-1].astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        full = at[1:] > at[:-1]
        content = (sums[at[1:]] - sums[at[:-1]])[full]
        label = (np.flatnonzero(full) + (cls << 32)).astype(np.uint64)
        out.append(mix64(content ^ mix64(label)))
        if (~full).sum() > spare:
            out.append(mix64(np.array([(cls << 32) + 2**31], np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def point(s: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Counts of dims groups, a power of two, at most 255: capping can only shorten distances."""
    return np.minimum(np.bincount((mix64(s ^ np.uint64(0xA5A5A5A5)) & np.uint64(dims - 1)).astype(np.int64), minlength=dims), 255).astype(np.uint8)


def fine_dims(n: int) -> int:
    """About eight shingles a group, which keeps the bound as sharp for long texts as for short ones."""
    return min(max(DIMS, 1 << max(0, (n // 8).bit_length())), 8192)


def folded(points: list[bytes]) -> np.ndarray:
    """The points at the resolution of the coarsest."""
    dims = min(map(len, points))
    out = np.empty((len(points), dims), np.uint8)
    for k, x in enumerate(points):
        v = np.frombuffer(x, np.uint8)
        out[k] = v if len(v) == dims else np.minimum(v.reshape(-1, dims).sum(0, dtype=np.int64), 255)
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows |a| + |b| less twice the summed minima."""
    out = np.zeros((len(a), len(b)), np.int32)
    a, b = a.T.astype(np.int16), b.T.astype(np.int16)
    for x, y in zip(a, b, strict=True):
        out += np.abs(x[:, None] - y[None, :])
    return out


def may_link(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs whose summed minima leave the overlap that a link needs, and whose sizes allow it."""
    total = na[:, None] + nb[None, :]
    sizes = (np.minimum(na[:, None], nb[None, :]) * den) >= (np.maximum(na[:, None], nb[None, :]) * num)
    if not sizes.any():
        return sizes
    # overlap <= (|A| + |B| - distance) / 2
    return sizes & ((total - _distance(a, b)) * (num + den) >= 2 * num * total)


def _overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the pairs' intersections; many pairs at once by products of incidence columns."""
    if len(pairs) < 400:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    used, flat = np.unique(pairs, return_inverse=True)
    flat = flat.reshape(pairs.shape)
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    token = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)[1]
    n = np.bincount(token)
    shared = n[token] > 1
    owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both, step = np.zeros((len(used), len(used)), np.float32), 4096
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        lo, hi = np.searchsorted(token, [at, at + step])
        m = np.zeros((len(used), step), np.float32)
        m[owner[lo:hi], token[lo:hi] - at] = 1
        both += m @ m.T
    return both[flat[:, 0], flat[:, 1]].astype(np.int64)


def forest_of(uids: np.ndarray, n: np.ndarray, points: np.ndarray, side: np.ndarray, sets: list[np.ndarray] | None, num: int, den: int, comp: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among uids; side 0 and 1 are two leaves, of which only crossing pairs count.

    Without sets, links are what the bound lets through. Sets of one comp are connected already.
    """
    if len(uids) == 2 and sets is None and not side.any():
        few, many = sorted(n.tolist())
        need = (few + many - int(np.abs(points[0].astype(np.int16) - points[1]).sum())) * (num + den) >= 2 * num * (few + many)
        return [(int(uids[0]), int(uids[1]))] if need and few * den >= many * num else []
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    f, out, found = Forest(len(uids)), [], []
    for at in range(0, len(a), 512):
        i, j = np.nonzero(may_link(n[a[at : at + 512]], points[a[at : at + 512]], n[b], points[b], num, den))
        if b is a:
            i, j = i[j > i + at], j[j > i + at]
        found.append(np.stack([a[i + at], b[j]]))
    i, j = np.concatenate(found, 1)
    if comp is not None:
        at = np.argsort(comp, kind="stable")
        for x, y in zip(at[:-1][comp[at[1:]] == comp[at[:-1]]].tolist(), at[1:][comp[at[1:]] == comp[at[:-1]]].tolist(), strict=True):
            f.join(x, y)
        apart = comp[i] != comp[j]
        i, j = i[apart], j[apart]

    def take(x: np.ndarray, y: np.ndarray) -> None:
        out.extend((int(uids[p]), int(uids[q])) for p, q in zip(x.tolist(), y.tolist(), strict=True) if f.join(p, q))

    if sets is None:
        take(i, j)
        return out
    # rounds: those of each set's nearest pairs first, then what is not yet connected
    order = np.argsort(np.abs(n[i] - n[j]), kind="stable")
    i, j = i[order], j[order]
    step = 2000
    while len(i):
        x, y = i[:step], j[:step]
        both = _overlaps(sets, np.stack([x, y], 1))
        hit = both * (num + den) >= num * (n[x] + n[y])
        take(x[hit], y[hit])
        roots = np.array([f.root(k) for k in range(len(uids))])
        i, j = i[step:], j[step:]
        apart = roots[i] != roots[j]
        i, j = i[apart], j[apart]
        step = min(step * 2, 20000)
    return out


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from a stream sorted by keys; a group is two leaves at most, a frame some more."""
    left = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
        last = np.ones(len(pdf), bool)
        for k in keys:
            last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
        cut = int(np.argmax(last))
        if cut:
            yield pdf.iloc[:cut]
        left = pdf.iloc[cut:]
    if left is not None:
        yield left


def _in_leaves(num: int, den: int, with_sets: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _runs(batches, ["root", "task"]):
            out: list[tuple[int, int]] = []
            root, task = pdf["root"].to_numpy(), pdf["task"].to_numpy()
            ends = np.flatnonzero(np.concatenate([(root[1:] != root[:-1]) | (task[1:] != task[:-1]), [True]])) + 1
            uids, n, side = pdf["uid"].to_numpy(), pdf["n"].to_numpy(), pdf["side"].to_numpy()
            points, comp = pdf["fine"].tolist(), pdf["comp"].to_numpy()
            blobs = pdf["set"].tolist() if with_sets else None
            at = 0
            for end in ends.tolist():
                sets = [np.frombuffer(x, np.uint64) for x in blobs[at:end]] if with_sets else None
                out += forest_of(uids[at:end], n[at:end], folded(points[at:end]), side[at:end], sets, num, den, comp[at:end])
                at = end
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
    return run


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, uid) sorted by both become the tiles of two sets or more, each content once: (a: tile, b: uid).

    Sets that are alike share many keys and so many equal tiles; a tile is named by its content and named again in
    this stream only after many others. A tile of over TILE sets isn't held: they are chained to its first, as rows
    (a: uid, b: first uid, chained).
    """
    seen = np.zeros(0, np.uint64)
    left, over = None, None
    for pdf in itertools.chain(batches, [None]):
        if pdf is None:
            if left is None:
                break
            k, u = left
            cut = len(k)
        else:
            k, u = pdf["key"].to_numpy(), pdf["uid"].to_numpy()
            if over is not None:
                more = k == over[0]
                if more.any():
                    yield pd.DataFrame({"a": u[more], "b": over[1], "chained": True})
                k, u = k[~more], u[~more]
            if left is not None:
                k, u = np.concatenate([left[0], k]), np.concatenate([left[1], u])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
        left = None if pdf is None else (k[cut:], u[cut:])
        k, u = k[:cut], u[:cut]
        if left is not None and len(left[0]) > TILE:
            over = (left[0][0], left[1][0])
            yield pd.DataFrame({"a": left[1][1:], "b": over[1], "chained": True})
            left = None
        if not len(k):
            continue
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.diff(np.append(starts, len(k)))
        name = mix64(np.add.reduceat(mix64(u.astype(np.uint64)), starts) + n.astype(np.uint64))
        met = np.flatnonzero(n > 1)
        met = met[~np.isin(name[met], seen)]
        met = met[np.unique(name[met], return_index=True)[1]]
        if not len(met):
            continue
        seen = np.concatenate([seen, name[met]]) if len(seen) < 300_000 else name[met]
        rows = np.repeat(starts[met], n[met]) + np.arange(n[met].sum()) - np.repeat(np.cumsum(n[met]) - n[met], n[met])
        yield pd.DataFrame({"a": np.repeat(name[met], n[met]).astype(np.int64), "b": u[rows], "chained": False})


def _byte(k: int):
    """Coordinate k of a point."""
    return F.conv(F.hex(F.substring("vec", k + 1, 1)), 16, 10).cast("int")


def _leaves(members: DataFrame, num: int, den: int, spent: list[str]) -> DataFrame:
    """root, leaf, uid, n, vec, comp: members in the order of own, size class and coordinates, cut into leaves from 0.

    No family is sorted in one task: cells of own, class, first coordinate and a hash are counted and summed up.
    """
    starts = size_classes(num, den)

    @F.pandas_udf("int")
    def class_of(n: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, n.to_numpy(), side="right").astype(np.int32) - 1)

    m = members.withColumns({"cls": class_of("n"), "c0": _byte(0), "c1": _byte(1), "sub": F.pmod(F.xxhash64("uid"), F.lit(256)), "w": F.greatest(F.ceil(F.col("n") / LONG), F.lit(1))})
    cell = ["root", "own", "cls", "c0", "sub"]
    counts = m.groupBy(*cell).agg(F.sum("w").alias("k"))
    upto = Window.partitionBy("root").orderBy(*cell[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = materialize(counts.select(*cell, (F.sum("k").over(upto) - F.col("k")).alias("before")), "leaf-cells", spent)
    place = F.sum("w").over(Window.partitionBy(*cell).orderBy("c1", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w")
    met = m.withColumn("place", place).join(before, cell)
    return materialize(met.select("root", F.floor((F.col("before") + F.col("place")) / LEAF).cast("long").alias("leaf"), "uid", "n", "vec", "comp"), "leaves", spent)


def _levels(leaves: DataFrame, spent: list[str]) -> list[DataFrame]:
    """The tree's nodes by level, leaves first, one root a family last: root, node, least, most, c_min, c_max, box."""
    def summed(x: DataFrame, node, least: str, most: str, low: str, high: str, coordinate) -> DataFrame:
        g = x.groupBy("root", node.alias("node")).agg(
            F.min(least).alias("least"), F.max(most).alias("most"), F.min(low).alias("c_min"), F.max(high).alias("c_max"), F.array(*[F.max(coordinate(k)) for k in range(DIMS)]).alias("box"))
        return materialize(g, "nodes", spent)

    out = [summed(leaves, F.col("leaf"), "n", "n", "comp", "comp", _byte)]
    while out[-1].agg(F.max("node")).first()[0]:
        out.append(summed(out[-1], F.shiftright("node", FAN), "least", "most", "c_min", "c_max", lambda k: F.col("box")[k]))
    return out


def _near_leaves(levels: list[DataFrame], num: int, den: int, spent: list[str]) -> DataFrame:
    """root, a, b: pairs of leaves, a <= b, that may hold links between sets not yet connected."""
    kept = ["least", "most", "c_min", "c_max", "box"]
    # summed minima of the largest coordinates bound every overlap; a capped coordinate bounds nothing
    bound = F.aggregate(F.zip_with("box_a", "box_b", lambda x, y: F.when((x >= 255) | (y >= 255), F.lit(2**24)).otherwise(F.least(x, y))), F.lit(0), lambda s, x: F.least(s + x, F.lit(2**25)))
    pairs = levels[-1].where("c_min < c_max").select("root", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        side = lambda x: level.select("root", F.shiftright("node", FAN).alias(x), F.col("node").alias(f"{x}2"), *[F.col(c).alias(f"{c}_{x}") for c in kept])  # noqa: B023, E731
        met = pairs.join(side("a"), ["root", "a"]).join(side("b"), ["root", "b"]).where("a2 <= b2 and not (c_min_a = c_max_b and c_max_a = c_min_b)")
        met = met.where((F.col("most_a") * den >= F.col("least_b") * num) & (F.col("most_b") * den >= F.col("least_a") * num))
        met = met.where((F.col("a2") == F.col("b2")) | (bound.cast("long") * (num + den) >= num * (F.col("least_a") + F.col("least_b"))))
        pairs = materialize(met.select("root", F.col("a2").alias("a"), F.col("b2").alias("b")), "near", spent)
    return pairs


def _leaf_tasks(leaves: DataFrame, pairs: DataFrame) -> DataFrame:
    """root, task, side, uid, comp for each pair of leaves, or leaf by itself."""
    task = F.xxhash64("a", "b").alias("task")
    ends = pairs.select("root", F.col("a").alias("leaf"), task, F.lit(0).alias("side")).union(pairs.where("a < b").select("root", F.col("b").alias("leaf"), task, F.lit(1).alias("side")))
    return leaves.select("root", "leaf", "uid", "comp").join(ends, ["root", "leaf"]).select("root", "task", "side", "uid", "comp")


def family_links(members: DataFrame, what: DataFrame, num: int, den: int, with_sets: bool, spent: list[str]) -> DataFrame:
    """Edges (a, b) that connect the sets of each family as far as they link. members: root, uid, n, vec.

    what: uid, n, fine and, with_sets, set. Without sets, links are what the bound lets through.
    """
    weight = F.sum(F.greatest(F.ceil(F.col("n") / LONG), F.lit(1)))
    sizes = materialize(members.groupBy("root").agg(weight.alias("g"), F.count("*").alias("k")).where("k > 1"), "family-sizes", spent)

    def edges(tasks: DataFrame) -> DataFrame:
        t = tasks.join(what, "uid").repartition("root", "task").sortWithinPartitions("root", "task")
        return t.mapInPandas(contracted(_in_leaves(num, den, with_sets)), "a long, b long")

    small = members.join(sizes.where(F.col("g") <= LEAF), "root").select("root", F.lit(0).cast("long").alias("task"), F.lit(0).alias("side"), "uid", F.col("uid").alias("comp"))
    found = edges(small)
    if sizes.where(F.col("g") > LEAF).isEmpty():
        return found
    big = members.join(sizes.where(F.col("g") > LEAF).select("root"), "root")
    leaves = _leaves(big.withColumns({"own": F.lit(-1).cast("long"), "comp": F.col("uid")}), num, den, spent)
    each = leaves.groupBy("root").agg(F.max("leaf").alias("last")).select("root", F.col("last"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("a"))
    chain = each.select("root", "a", F.explode(F.when(F.col("a") < F.col("last"), F.array("a", F.col("a") + 1)).otherwise(F.array("a"))).alias("b"))
    first = materialize(edges(_leaf_tasks(leaves, chain)), "leaf-links", spent)
    joined = components(first, spent, contract=False).select(F.col("id").alias("uid"), F.col("root").alias("comp"))
    big = materialize(big.join(joined, "uid", "left").withColumn("comp", F.coalesce("comp", "uid")), "families", spent)
    whole = materialize(big.groupBy("root", "comp").agg(F.count("*").alias("k")).where(F.col("k") >= LEAF).select("root", "comp", F.col("comp").alias("own")), "large-parts", spent)
    leaves = _leaves(big.join(whole, ["root", "comp"], "left").withColumn("own", F.coalesce("own", F.lit(-1).cast("long"))), num, den, spent)
    pairs = _near_leaves(_levels(leaves, spent), num, den, spent)
    return found.union(first).union(edges(_leaf_tasks(leaves, pairs)))


def text_key(text):
    """Tells texts apart that have one doc_id."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def ngram_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, slices: int = 1, left: list[str] | None = None, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; sets link when den * intersection >= num * union.

    slices: the tiles' keys are dealt out in so many turns, to hold fewer of them on disk at a time.
    left: gets the path of the written result. by_text adds text_key and part, a number of the component.
    """
    spark = docs.sparkSession
    ship(spark)
    spent: list[str] = []
    docs = docs.select(hide_null("doc_id"), F.col("text").cast("string").alias("text"), (text_key(F.col("text")) if by_text else F.lit("")).alias("text_key"))

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, k in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["text_key"], strict=True):
                s = shingle_set(text, width)
                d = xxhash.xxh3_128_digest(s.tobytes())
                rows.append((i, k, len(s), d, tile_keys(s, num, den).astype(np.int64) if len(s) else np.zeros(0, np.int64), point(s).tobytes(), point(s, fine_dims(len(s))).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n", "sha", "keys", "vec", "fine"])

    full: list[str] = []
    prof = materialize(docs.mapInPandas(with_rows(profile), "doc_id long, text_key string, n long, sha binary, keys array<long>, vec binary, fine binary"), "profiles", full)
    low = F.min(F.when(F.col("doc_id") != NONE, F.col("doc_id"))).alias("low")
    reps = materialize(prof.where("n > 0").groupBy("sha").agg(low, F.max("doc_id").alias("at"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("keys", "vec", "fine")]).withColumn(
        "uid", F.monotonically_increasing_id()), "sets", spent)
    prof = materialize(prof.select("doc_id", "text_key", "n", "sha"), "ids", spent)
    drop_paths(spark, full)
    spark.sparkContext._jvm.System.gc()  # lets go of the shuffle

    found = None
    for k in range(slices):
        turn = F.expr(f"filter(keys, x -> pmod(x, {slices}) = {k})") if slices > 1 else F.col("keys")
        keys = reps.select("uid", F.explode(turn).alias("key")).repartition("key").sortWithinPartitions("key", "uid")
        met = materialize(keys.mapInPandas(_tiles, "a long, b long, chained boolean"), "tiles", spent)
        spark.sparkContext._jvm.System.gc()  # lets go of the turn's shuffle
        found = met if found is None else found.union(met)
    tiles = found.where("not chained").select(F.col("a").alias("task"), F.col("b").alias("uid")).distinct()
    tiles = tiles.join(reps.select("uid", "n", "fine"), "uid").select(F.lit(0).cast("long").alias("root"), "task", F.lit(0).alias("side"), "uid", F.col("uid").alias("comp"), "n", "fine")
    edges = tiles.repartition("root", "task").sortWithinPartitions("root", "task").mapInPandas(contracted(_in_leaves(num, den, False)), "a long, b long")
    edges = edges.union(found.where("chained").select("a", "b").mapInPandas(contracted(lambda batches: batches), "a long, b long"))
    members = components(edges, spent, contract=False).select(F.col("id").alias("uid"), "root").join(reps.select("uid", "n", "vec"), "uid")
    members = materialize(members.select("root", "uid", "n", "vec"), "families", spent)

    large = members.groupBy("root").count().where(F.col("count") > LEAF).select("root")
    if not large.isEmpty():
        bound = family_links(members.join(large, "root", "left_semi"), reps.select("uid", "n", "fine"), num, den, False, spent)
        parts = components(bound, spent, contract=False).select(F.col("id").alias("uid"), "root").join(reps.select("uid", "n", "vec"), "uid")
        members = materialize(members.join(large, "root", "left_anti").union(parts.select("root", "uid", "n", "vec")), "families", spent)

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for uid, sha, text in zip(pdf["uid"].tolist(), pdf["sha"], pdf["text"], strict=True):
                s = shingle_set(text, width)
                if xxhash.xxh3_128_digest(s.tobytes()) == bytes(sha):
                    rows.append((uid, len(s), point(s, fine_dims(len(s))).tobytes(), s.tobytes()))
            yield pd.DataFrame(rows, columns=["uid", "n", "fine", "set"])

    wanted = members.join(members.groupBy("root").count().where("count > 1"), "root", "left_semi").select("uid").join(reps.select("uid", F.col("at").alias("doc_id"), "sha"), "uid")
    sets = docs.join(wanted, "doc_id").select("uid", "sha", "text").mapInPandas(with_rows(sets_of), "uid long, n long, fine binary, set binary").dropDuplicates(["uid"])
    sets = materialize(sets, "family-sets", spent)
    links = family_links(members, sets, num, den, True, spent)
    linked = components(links, spent, contract=False).select(F.col("id").alias("uid"), "root")
    named = reps.select("uid", "sha", "low").join(linked, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    names = named.groupBy("root").agg(F.min("low").alias("component"))
    out = materialize(named.join(names, "root").select("sha", "component", F.col("root").alias("part")), "parts", spent)
    result = prof.join(out, "sha", "left").select(
        show_null("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, show_null("doc_id")).otherwise(F.col("component")).alias("component_id"),
        *(["text_key", "part"] if by_text else []))
    result = materialize(result, "components", left)
    drop_paths(spark, spent)
    return result


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, slices: int = 1, left: list[str] | None = None) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id, null last, then the smallest text key.

    Rows are told apart by doc_id and text; of rows that repeat both, one stays. Texts without words all stay.
    left: as for ngram_components.
    """
    c = ngram_components(docs, width, num, den, slices, left, by_text=True).where("n_shingles > 0").withColumn("doc_id", F.coalesce("doc_id", F.lit(NONE)))
    place = F.struct((F.col("doc_id") == NONE).alias("none"), "doc_id", "text_key")
    first = materialize(c.groupBy("part").agg(F.min(place).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "first-of-part", left)
    met = c.join(first, "part").select("doc_id", "text_key", (place != F.col("first")).alias("goes"))
    gone = materialize(met.where("goes").select("doc_id", "text_key").distinct(), "gone", left)
    # the first of its part may be there more than once
    again = materialize(met.where("not goes").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "again", left)
    i, k = "_id_", "_text_key_"
    while {i, k} & {x.lower() for x in docs.columns}:
        i, k = i + "_", k + "_"
    keyed = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)), k: text_key(F.col("text"))})
    named = lambda x: x.withColumnsRenamed({"doc_id": i, "text_key": k})
    stay = keyed.join(named(gone), [i, k], "left_anti")
    if not again.isEmpty():
        stay = stay.join(named(again), [i, k], "left_anti").unionByName(stay.join(named(again), [i, k], "left_semi").dropDuplicates([i, k]))
    return stay.select(*[F.col(f"`{x}`") for x in docs.columns])
