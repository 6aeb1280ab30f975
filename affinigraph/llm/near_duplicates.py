"""Near-duplicate documents by bottom-k sketches from one hash function, verified exactly.

1. Each text becomes its set of hashed word shingles; texts with equal sets are one class, under its smallest id.
2. A class keeps the k smallest hashes. Inverted lists of these values give overlaps: for each pair in a list of at most
   ``short`` classes the shared values are counted, and the union-sketch bound keeps pairs that can still reach the
   threshold. Values in longer lists say little (a passage or page furniture that many documents share); only classes
   of which such values make up a quarter or more are brought together by them.
3. What is brought together is compared whole: exact overlaps of full shingle sets, in blocks of bounded size whose
   members differ little enough in size, as matrix products. Only a spanning forest of the verified links leaves a block.
   A large group is first compared with some leaders of each size. Members that these links connect need no comparison
   among each other, so what remains is to compare those outside the group's largest component with all: a family of many
   near copies costs in proportion to its members, not to their pairs.
4. Links give components, whose smallest id stays.

With k retained values a pair at the threshold is missed with a probability below 1e-6. ``exact`` retains as many values of
each set as two linked sets must share one of (those that may be missing, and one more), and brings together all classes
with a common retained value, so that no link can be missed; it costs more where passages are common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_struct, binary_buffers, from_struct, joined_by, materialize, mix64, ship, split_batch
from .components import connected_components

#: Shingles of a block at most (32 MB), unless a single text has more.
BLOCK_SHINGLES = 1 << 22
SETS = "doc_id long, n long, f1 long, f2 long, sketch array<long>"
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, kept by each worker."""
    have = getattr(_powers, "kept", None)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers.kept = tuple(out)
    return have


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text of a buffer.

    Letters A-Z are lower-cased; words end at blanks and the control characters 9 to 13. A text of fewer words is one
    shingle, an empty one none.
    """
    docs = len(offsets) - 1
    empty = np.zeros(0, np.uint64)
    if not len(raw):
        return [empty] * docs
    inside = ~_SPACE[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:-1]
    start, end = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    token = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    bounds = np.searchsorted(start, offsets)
    factor = np.cumprod(np.full(words, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)
    n = len(token)
    full = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        full += token[k : k + len(full)] * factor[k]
    full = mix64(full)
    out = []
    for i in range(docs):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= words:
            s = np.sort(full[a : b - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix64(np.array([(token[a:b] * factor[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(empty)
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent sums over a set, as signed 64-bit numbers."""
    two = np.array([s.sum(dtype=np.uint64), mix64(s ^ np.uint64(_BASE)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(two[0]), int(two[1])


def sketches(docs: DataFrame, words: int, k: int, percent: int, exact: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, "text_"):
                sets = shingle_sets(*binary_buffers(batch.column(1)), words)
                prints = [fingerprint(s) for s in sets]
                kept = [s[: max(k, len(s) - -(-len(s) * percent // 100) + 1) if exact else k] for s in sets]
                flat = np.concatenate(kept).view(np.int64)
                ends = np.concatenate(([0], np.cumsum([len(s) for s in kept]))).astype(np.int32)
                numbers = [pa.array(c, pa.int64()) for c in ([len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints])]
                sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, sketch], names=["doc_id", "n", "f1", "f2", "sketch"])

    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text_")).mapInArrow(run, SETS)


def candidates(classes: DataFrame, k: int, short: int, threshold: float, exact: bool = False, hot: int = 16) -> DataFrame:
    """Edges (a, b) that bring together all classes that may reach the threshold. ``classes``: id, n, sketch."""
    postings = classes.select("id", "n", F.explode("sketch").alias("v"))
    counts = postings.groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") >= 2)
    lists = materialize(postings.join(counts, "v"), "postings")
    common = lists.where(F.col("c") > short).groupBy("id").agg(F.count("*").alias("hot"))
    common = materialize(common, "common")

    member, alike = F.struct("id", "n"), lambda p, q: F.least(p["n"], q["n"]) >= threshold * F.greatest(p["n"], q["n"])

    def pair(p, q):
        larger = p["n"] >= q["n"]
        return F.struct(F.when(larger, p["id"]).otherwise(q["id"]).alias("a"), F.when(larger, q["id"]).otherwise(p["id"]).alias("b"), F.greatest(p["n"], q["n"]).alias("n"))

    met = lists.where(F.col("c") <= short).groupBy("v").agg(F.array_sort(F.collect_list(member)).alias("x"))  # at most ``short`` members
    each = F.flatten(F.transform("x", lambda p, i: F.transform(F.filter(F.slice("x", i + 2, F.size("x")), lambda q: alike(p, q)), lambda q: pair(p, q))))
    pairs = met.select(F.explode(each).alias("p")).select("p.*").groupBy("a", "b", "n").agg(F.count("*").alias("shared"))
    long = lists.where(F.col("c") > short)
    if exact:
        shared = materialize(long.select("id", "v"), "common_lists")
        edges = pairs.select("a", "b")
    else:
        # Of the larger set's kept values at most 1 - threshold are missing in the other; beyond k that share is a
        # sample's, and 5 standard deviations are granted. The rest that is not common must show up as shared.
        kept = F.least(F.col("n"), F.lit(k))
        chance = F.when(F.col("n") > k, F.ceil(5 * F.sqrt(F.lit(k * threshold * (1 - threshold))))).otherwise(0)
        least = kept - F.coalesce("hot", F.lit(0)) - F.floor((1 - threshold) * kept) - chance
        edges = pairs.join(common, pairs.a == common.id, "left").where(F.col("shared") >= F.greatest(F.lit(1), least)).select("a", "b")
        # The same bottom-k rule among common values: the ``hot`` smallest of a class are enough to meet its likes.
        mostly = long.groupBy("id", "n").agg(F.array_sort(F.collect_list("v")).alias("vs")).where(4 * F.size("vs") >= kept)
        shared = materialize(mostly.select("id", F.explode(F.slice("vs", 1, hot)).alias("v")), "common_lists")
    first = materialize(shared.groupBy("v").agg(F.min("id").alias("b")), "common_first")
    stars = joined_by(shared, first, ["v"], F.col("id")).select(F.col("id").alias("a"), "b").where(F.col("a") != F.col("b"))
    return edges.unionByName(stars)


def links_between(sizes_a: np.ndarray, sets_a: list[np.ndarray], sizes_b: np.ndarray, sets_b: list[np.ndarray], percent: int, columns: int = 2048) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union: overlaps as products of 0/1 blocks."""
    owner_a, owner_b = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (sets_a, sets_b))
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    both = np.intersect1d(flat_a, flat_b)
    overlap = np.zeros((len(sets_a), len(sets_b)), np.float32)
    at_a, at_b = np.searchsorted(both, flat_a), np.searchsorted(both, flat_b)
    for at, flat in ((at_a, flat_a), (at_b, flat_b)):
        at[at == len(both)] = 0
        at[both[at] != flat if len(both) else slice(None)] = -1
    ok_a, ok_b = at_a >= 0, at_b >= 0
    at_a, owner_a, at_b, owner_b = at_a[ok_a], owner_a[ok_a], at_b[ok_b], owner_b[ok_b]
    by_a, by_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    at_a, owner_a, at_b, owner_b = at_a[by_a], owner_a[by_a], at_b[by_b], owner_b[by_b]
    for low in range(0, len(both), columns):
        width = min(columns, len(both) - low)
        m = []
        for at, owner, rows in ((at_a, owner_a, len(sets_a)), (at_b, owner_b, len(sets_b))):
            i, j = np.searchsorted(at, [low, low + width])
            x = np.zeros((rows, width), np.float32)
            x[owner[i:j], at[i:j] - low] = 1
            m.append(x)
        overlap += m[0] @ m[1].T
    return 100 * overlap >= percent * (sizes_a[:, None] + sizes_b[None, :] - overlap)


def forest(ids_a: np.ndarray, ids_b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest id reached, for the vertices that a block's links move."""
    a, b = ids_a.copy(), ids_b.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(linked, b[None, :], top).min(axis=1, initial=top))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], top).min(axis=0, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    x, y = np.concatenate([ids_a, ids_b]), np.concatenate([a, b])
    moved = x != y
    return x[moved], y[moved]


def verified(docs: DataFrame, groups: DataFrame, words: int, percent: int, block: int, leaders: int, key: str, text: str) -> DataFrame:
    """Edges (a, b) with the components of the links inside each group. ``groups``: id, n, f1, f2, label.

    A group of at most ``block`` members (and as many shingles as BLOCK_SHINGLES) is compared at once. A larger one is cut by
    size class (a pair that reaches the threshold is in one class or in neighbouring ones) and by a hash into blocks. Its
    blocks meet ``leaders`` of each class first, then those members that are still outside its largest component.
    """
    ratio = float(np.log(100 / percent))
    size = groups.groupBy("label").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    size = materialize(size, "sizes")
    own = materialize(joined_by(groups, size, ["label"], F.col("id")), "sized")
    fits = (F.col("size") <= block) & (F.col("total") <= BLOCK_SHINGLES)
    unit = F.struct("cls", "part", "c2", "p2")
    zero, one = F.lit(0).alias("side"), F.lit(1).alias("side")
    members = members_of(docs, own.withColumn("fits", fits), words, key, text)
    whole = own.where(fits).select("id", "n", "label", *(F.lit(0).alias(c) for c in ("cls", "part", "c2", "p2")))
    found = compared(members.where("fits"), whole.select("id", "n", "label", unit.alias("unit"), zero), percent)
    if not size.where(~fits).limit(1).count():
        return found
    large = own.where(~fits).withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int"))
    number = lambda: F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    parts = materialize(large.groupBy("label", "cls").agg(number().alias("parts")), "parts")
    large = joined_by(large, parts, ["label", "cls"], F.col("id")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    large = materialize(large.select("id", "n", "label", "cls", "part"), "blocks")
    cells = parts.select("label", "cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def meet(others: DataFrame, name: str) -> DataFrame:
        """All blocks with ``others`` (as ``large``, with their own part p2), where the classes are neighbours."""
        theirs = others.select(F.col("label").alias("l2"), F.col("cls").alias("c2"), "p2").distinct()
        close = (F.col("label") == F.col("l2")) & (F.abs(F.col("cls") - F.col("c2")) <= 1)
        units = materialize(cells.join(theirs, close).drop("l2"), "units")
        told = units.groupBy("label", "cls", "part").agg(F.collect_list(F.struct("c2", "p2")).alias("x"))
        left = joined_by(large, told, ["label", "cls", "part"], F.col("id"), small=False).withColumn("x", F.explode("x"))
        left = left.select("id", "n", "label", F.struct("cls", "part", "x.c2", "x.p2").alias("unit"), zero)
        told = units.groupBy("label", F.col("c2").alias("cls"), "p2").agg(F.collect_list(F.struct(F.col("cls").alias("c1"), "part")).alias("x"))
        right = joined_by(others, told, ["label", "cls", "p2"], F.col("id"), small=False).withColumn("x", F.explode("x"))
        right = right.select("id", "n", "label", F.struct(F.col("x.c1").alias("cls"), F.col("x.part").alias("part"), F.col("cls").alias("c2"), "p2").alias("unit"), one)
        return materialize(compared(members.where("NOT fits"), left.unionByName(right), percent), name)

    nth = F.row_number().over(Window.partitionBy("label", "cls").orderBy(F.xxhash64("id", F.lit("lead")), "id"))
    led = meet(materialize(large.withColumn("nth", nth).where(F.col("nth") <= leaders).withColumn("p2", F.lit(0)), "leaders"), "led")
    joined = materialize(large.join(connected_components(led).withColumnRenamed("label", "to"), "id", "left").withColumn("to", F.coalesce("to", "id")), "joined")
    largest = joined.groupBy("label", "to").agg(F.count("*").alias("c")).groupBy("label").agg(F.max_by("to", F.struct("c", "to")).alias("main"))
    rest = joined_by(joined, materialize(largest, "largest"), ["label"], F.col("id")).where(F.col("to") != F.col("main"))
    rest = materialize(rest.drop("part", "main", "to"), "rest")
    if rest.limit(1).count():
        again = materialize(rest.groupBy("label", "cls").agg(number().alias("parts")), "rest_parts")
        rest = joined_by(rest, again, ["label", "cls"], F.col("id")).withColumn("p2", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        led = led.unionByName(meet(materialize(rest, "rest_blocks"), "rest_links"))
    return found.unionByName(led)


def members_of(docs: DataFrame, groups: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(id, fits, members): the whole shingle set of each class in a group, written once; texts are shuffled here only."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, "text_", 1 << 20):
                sets = shingle_sets(*binary_buffers(batch.column(0)), words)
                prints = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
                own = [fingerprint(s) == p for s, p in zip(sets, prints, strict=True)]
                cols = [batch.column(1), batch.column(4), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "fits", "members"]).filter(pa.array(own, pa.bool_()))

    wanted = groups.select("id", "f1", "f2", "fits").hint("merge")  # the ids grow with the documents: never sent whole
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text_")).join(wanted, "id").select("text_", "id", "f1", "f2", "fits")
    return materialize(rows.mapInArrow(again, "id long, fits boolean, members binary"), "members")


def compared(members: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b), a spanning forest of the links of each unit of work. ``placed``: id, n, label, unit, side; side 0 is
    compared with side 1, or with itself where there is no side 1."""
    work = placed.join(members.hint("merge"), "id")

    def compare(t: pa.Table) -> pa.Table:
        ids, side, n = (t.column(c).to_numpy() for c in ("id", "side", "n"))
        _, at = np.unique(np.stack([ids, side]), axis=1, return_index=True)  # a repeated row adds nothing
        ids, side, n = ids[at], side[at], n[at]
        sets = [np.frombuffer(t.column("members")[int(i)].as_py(), np.uint64) for i in at]
        a = np.nonzero(side == 0)[0]
        b = np.nonzero(side == 1)[0] if (side == 1).any() else a
        x, y = (ids[:0], ids[:0]) if not len(a) else forest(ids[a], ids[b], links_between(n[a], [sets[i] for i in a], n[b], [sets[i] for i in b], percent))
        return pa.table([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return work.groupBy("label", "unit").applyInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 75, k: int = 64, exact: bool = False, short: int = 48, block: int = 2048,
    leaders: int = 64, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each non-null id.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. Null and empty texts have no
    shingles and link with nothing. Of several rows with one id, that with the fewest shingles counts.
    """
    spark = docs.sparkSession
    ship(spark)
    every = materialize(sketches(docs, words, k, percent, exact, key, text), "sketches")
    own = every.groupBy("doc_id").agg(F.min(F.struct("n", "f1", "f2")).alias("s")).select("doc_id", "s.*")
    classes = materialize(own.where(F.col("n") > 0).groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id")), "classes")
    kept = every.join(classes.select(F.col("id").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"]).groupBy(F.col("doc_id").alias("id")).agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    groups = connected_components(candidates(materialize(kept, "kept"), k, short, percent / 100, exact))
    groups = materialize(classes.join(groups, "id"), "groups")
    links = connected_components(verified(docs, groups, words, percent, block, leaders, key, text))
    label = materialize(classes.join(links, "id", "left").select("n", "f1", "f2", F.coalesce("label", "id").alias("component_id")), "labels")
    out = joined_by(own, label, ["n", "f1", "f2"], F.col("doc_id"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows, with all their columns, without those of which a near duplicate stays: of a component that with the smallest
    id, of equal ids the first row; a null id comes last. Each row is judged by its own text, whatever its id."""
    rows = materialize(docs.select(as_struct(docs), F.monotonically_increasing_id().alias("row_id_"), F.col("`" + options.get("text", "text") + "`").alias("text_")), "rows")
    own = near_duplicates(rows, key="row_id_", **options | {"text": "text_"}).where(F.col("n_shingles") > 0).select(F.col("doc_id").alias("row_id_"), "component_id")
    order = F.struct(F.col(f"row_.{key}").isNull(), F.col(f"row_.{key}"), F.col("row_id_"))
    placed = materialize(own.join(rows.select("row_id_", order.alias("order")), "row_id_"), "placed_rows")
    first = materialize(placed.groupBy("component_id").agg(F.min("order").alias("first")), "first_rows")
    gone = joined_by(placed, first, ["component_id"], F.col("row_id_")).where(F.col("order") != F.col("first")).select("row_id_")
    return from_struct(rows.join(gone, "row_id_", "left_anti"), docs.columns, {})
