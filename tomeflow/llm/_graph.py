"""Links between near duplicates and the groups they form, without all pairs of a bucket in one task and without the driver.

Members of a bucket are dealt to blocks of bounded size. A unit is a block, or two blocks whose members are compared
with each other; its texts are shipped to one task, which keeps the groups of the unit's members and compares only
those that nothing joins yet. So rows shipped grow with the members of a bucket (and with the square of the number
of its blocks only where blocks hold members of different groups), pairs never become rows, and what leaves a unit is
a spanning forest of its links.

The low six bits of a bucket number are its band. A pair that shares several buckets is compared in that of the least
band; buckets of band LOOSE are not counted in this.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Shelf, batch_of, stored, whole_groups
from ._words import mixed

LOOSE = 63
#: About the members of a block and the characters of their texts.
MEMBERS, CHARS = 512, 1 << 20
#: Links that one task of components() holds.
LINKS = 1_000_000
#: One member in SAMPLE is looked at to find the buckets of more than CROWD members or so, which are dealt by member.
SAMPLE, CROWD = 64, 100_000

#: Members that are packed at once, and parts that they are dealt to for each task.
PACK, PARTS = 1 << 20, 4

#: Pairs of a table of units that are looked at in one go.
PAIRS = 1 << 19

#: Pairs of texts that wait to be checked at once.
WAITING = 8192

#: What a linker asks for and gets back: pairs of texts with a limit each, and whether they are linked.
Checks = Generator[tuple[list[tuple[str, str]], np.ndarray], np.ndarray, None]
Check = Callable[[list[tuple[str, str]], np.ndarray], np.ndarray]
#: Given texts, pairs (i, j) of them that may be linked, and the groups so far, joins what is linked; pairs that are
#: joined already may be left out. Pairs that it yields are checked with those of other runs of units.
Linker = Callable[[list[str], np.ndarray, np.ndarray, "Groups"], Checks]


class Groups:
    """The groups of the members of some units. Members of a unit stand together, so a join touches its rows only."""

    def __init__(self, label: np.ndarray, edges: np.ndarray) -> None:
        self.label, self.links = label.copy(), []
        self._begin, self._stop = (np.repeat(x, np.diff(edges)) for x in (edges[:-1], edges[1:]))

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.label[i] != self.label[j]

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.links.append((i, j))
            rows = self.label[self._begin[i] : self._stop[i]]
            rows[rows == b] = a


def in_band(keys: np.ndarray, band: np.ndarray | int) -> np.ndarray:
    """Bucket numbers of keys (unsigned) with their band in the low bits."""
    return (keys & ~np.uint64(LOOSE) | np.asarray(band).astype(np.uint64)).view(np.int64)


def packed_keys(keys: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Bucket numbers as binary values, the first counts[0] of keys in the first: Spark moves these whole."""
    offsets = np.concatenate([[0], 8 * np.cumsum(counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys))])


def _unpacked(members: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The buckets and the ids of members, a row for each (bucket, id) or for each (buckets, id) with packed buckets."""
    first, ids = members.column(0), members.column(1).to_numpy()
    if not pa.types.is_binary(first.type):
        return first.to_numpy(), ids
    offsets = np.frombuffer(first.buffers()[1], np.int32, len(first) + 1, 4 * first.offset)
    keys = np.frombuffer(first.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.int64)
    return keys, np.repeat(ids, np.diff(offsets) // 8)


def _spread(members: DataFrame) -> DataFrame:
    """Members with packed buckets as (bucket, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, ids = _unpacked(batch)
            yield batch_of({"bucket": bucket, "id": ids}, {})

    return members.select("buckets", "id").mapInArrow(run, "bucket long, id long") if "buckets" in members.columns else members


def _pairs(unit: np.ndarray, band: np.ndarray, side: np.ndarray, keys: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, i, j) of runs of whole units with their pairs, i and j counted from the first row.

    Members of sides 0 and 1 are paired across only, those of side 2 with all; pairs that share one of their keys in a
    band below the unit's are left out. of: the row of each key.
    """
    edges = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])
    sizes = np.diff(edges)
    made = np.cumsum(sizes * (sizes - 1) // 2)
    table = np.zeros((len(unit), LOOSE), np.int64)
    firm = keys & LOOSE < LOOSE
    table[of[firm], keys[firm] & LOOSE] = keys[firm]
    triangles = {int(m): np.triu_indices(m, 1) for m in np.unique(sizes)}
    u = 0
    while u < len(sizes):
        stop = max(u + 1, int(np.searchsorted(made, (made[u - 1] if u else 0) + PAIRS, "right")))
        i, j = (np.concatenate([triangles[m][k] + b for m, b in zip(sizes[u:stop].tolist(), edges[u:stop].tolist())]) for k in range(2))
        keep = (side[i] == 2) | (side[i] != side[j])
        i, j = i[keep], j[keep]
        new, bands = np.ones(len(i), bool), band[i]
        for c in range(int(bands.max(initial=0))):
            at, keys_c = np.flatnonzero(bands > c), table[edges[u] : edges[stop], c].copy()
            ours = keys_c[i[at] - edges[u]]
            new[at[(ours == keys_c[j[at] - edges[u]]) & (ours != 0)]] = False
        yield edges[u], edges[stop], i[new] - edges[u], j[new] - edges[u]
        u = stop


def _unit_links(rows: DataFrame, link: Linker, check: Check | None) -> DataFrame:
    """Links (a, b) inside the units of rows (unit, band, id, label, side, text, keys) that join what all links would."""

    def started(part: pa.Table) -> Iterator[tuple[np.ndarray, Groups, Checks]]:
        unit, band, ids, label, side = (part.column(c).to_numpy() for c in ("unit", "band", "id", "label", "side"))
        texts, keys = [t or "" for t in part.column("text").to_pylist()], part.column("keys").combine_chunks()
        of = np.repeat(np.arange(len(unit)), keys.value_lengths().to_numpy())
        for a, b, i, j in _pairs(unit, band, side, keys.flatten().to_numpy(), of):
            edges = np.concatenate([[a], np.flatnonzero(unit[a + 1 : b] != unit[a : b - 1]) + a + 1, [b]]) - a
            groups = Groups(label[a:b], edges)
            differ = groups.apart(i, j)
            yield ids[a:b], groups, link(texts[a:b], i[differ], j[differ], groups)

    def finished(waiting: list[tuple[np.ndarray, Groups, Checks, tuple]]) -> Iterator[pa.RecordBatch]:
        """Checks what waits, over and over until no run of units asks for more."""
        while waiting:
            said = check([p for *_, (pairs, _) in waiting for p in pairs], np.concatenate([limits for *_, (_, limits) in waiting]))
            at, again = 0, []
            for ids, groups, steps, (pairs, _) in waiting:
                try:
                    again.append((ids, groups, steps, steps.send(said[at : at + len(pairs)])))
                except StopIteration:
                    yield linked(ids, groups)
                at += len(pairs)
            waiting = again

    def linked(ids: np.ndarray, groups: Groups) -> pa.RecordBatch:
        at = np.array(groups.links, np.int64).reshape(-1, 2)
        return batch_of({"a": ids[at[:, 0]], "b": ids[at[:, 1]]}, {"a": pa.int64(), "b": pa.int64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for part in whole_groups(batches, ["unit"]):
            for ids, groups, steps in started(part):
                asked = next(steps, None)
                if asked is None:
                    yield linked(ids, groups)
                else:
                    waiting.append((ids, groups, steps, asked))
                    n += len(asked[0])
                if n >= WAITING:
                    yield from finished(waiting)
                    waiting, n = [], 0
        yield from finished(waiting)

    together = rows.repartition(_tasks(rows), "unit").sortWithinPartitions("unit")
    return together.select("unit", "band", "id", "label", "side", "text", "keys").mapInArrow(run, "a long, b long")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sharing(shelf: Shelf, members: DataFrame) -> DataFrame:
    """The members (bucket, id) whose bucket has another one; members may come as (buckets, id), see packed_keys.

    Members travel packed, a row for those of a PACK that go to one part, and a part is sorted by bucket at once. Only
    buckets that a sample shows to be crowded, which need no count, stay where they are. The sample decides on that alone.
    """
    some = _spread(members.where(F.pmod(F.xxhash64(F.lit("crowd"), "id"), F.lit(SAMPLE)) == 0))
    crowded = shelf.put(some.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD // SAMPLE).select("bucket"), "crowded")
    tasks = _tasks(members)
    parts = PARTS * tasks

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(_unpacked(batch))
            n += len(held[-1][0])
            if n >= PACK:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        part = ((mixed(bucket.view(np.uint64)) >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        there, begins = np.unique(part[order], return_index=True)
        offsets = pa.py_buffer(8 * np.append(begins, len(order)).astype(np.int32))
        columns = {c: pa.Array.from_buffers(pa.binary(), len(there), [None, offsets, pa.py_buffer(x[order])]) for c, x in (("buckets", bucket), ("ids", ids))}
        return batch_of({"part": there.astype(np.int64), **columns}, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["part"]):
            bucket, ids = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("buckets", "ids"))
            order = np.argsort(bucket)
            bucket = bucket[order]
            same = bucket[1:] == bucket[:-1]
            keep = np.append(same, False) | np.append(False, same)
            yield batch_of({"bucket": bucket[keep], "id": ids[order[keep]]}, {})

    few, many = members.select("buckets" if "buckets" in members.columns else "bucket", "id"), None
    if not crowded.isEmpty():
        each = _spread(members).select("bucket", "id")
        few, many = each.join(crowded, "bucket", "left_anti"), each.join(crowded, "bucket")
    dealt = few.mapInArrow(pack, "part long, buckets binary, ids binary").repartition(tasks, "part").sortWithinPartitions("part")
    found = dealt.mapInArrow(run, "bucket long, id long")
    return found if many is None else found.unionByName(many)


def _blocks(n: Column, weight: Column, most: int) -> Column:
    return F.greatest(F.ceil(n / most), F.ceil(weight / CHARS), F.lit(1))


def _across(shelf: Shelf, wide: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """(unit, band, id, label, side) of the pairs of blocks in which members of wide (bucket, id, weight) with different
    labels meet.

    The members of a bucket's largest group are its crowd, all others stand apart. Blocks of the crowd meet blocks
    of those apart, and these meet each other and themselves; blocks of the crowd need not meet.
    """
    named = wide.join(groups.toDF("id", "root"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    by_label = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    tops = by_label.groupBy("bucket").agg(F.max(F.struct("n", "label", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    plan = tops.select("bucket", F.col("top.label").alias("crowd"), _blocks(F.col("top.n"), F.col("top.w"), most).alias("kc"), _blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w"), most).alias("ka"))
    placed = named.join(shelf.put(plan, "plan"), "bucket").withColumn("out", F.col("label") != F.col("crowd"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit("across"), "id"), F.when(F.col("out"), F.col("ka")).otherwise(F.col("kc"))))
    meetings = F.expr("""CASE WHEN out THEN concat(
      transform(sequence(0L, kc - 1), c -> struct(c * ka + block AS u, 1 AS side)),
      transform(sequence(0L, ka - 1), j -> struct((kc + least(j, block)) * ka + greatest(j, block) AS u, CASE WHEN j = block THEN 2 WHEN block < j THEN 0 ELSE 1 END AS side)))
    ELSE transform(sequence(0L, ka - 1), j -> struct(block * ka + j AS u, 0 AS side)) END""")
    met = placed.select("bucket", "id", "label", F.explode(meetings).alias("m"))
    return met.select(F.xxhash64("bucket", "m.u").alias("unit"), _band("bucket").alias("band"), "id", "label", "m.side")


def _band(bucket: str) -> Column:
    return F.col(bucket).bitwiseAND(F.lit(LOOSE)).cast("int")


def bucket_groups(members: DataFrame, payload: Callable[[DataFrame], DataFrame], link: Linker, check: Check | None = None, most: int = MEMBERS) -> DataFrame:
    """(node, root) of the members (bucket, id) of buckets that links between members of one bucket join; members may
    come as (buckets, id) with the packed buckets of each id.

    payload gives (id, text), once for each of the wanted ids, those that share a bucket. First each block is compared within itself; equal sets of members that meet in several buckets are one unit. Then
    buckets of several blocks that are not one group yet have their blocks compared with each other (see _across). So
    each pair of a bucket is compared or joined by other links, whatever the size of the bucket.
    """
    with Shelf(members.sparkSession) as shelf:
        shared = shelf.put(_sharing(shelf, members), "shared", compression="zstd")
        keys = shared.groupBy("id").agg(F.collect_set("bucket").alias("keys"))
        texts = shelf.put(payload(keys.select("id")).join(keys, "id"), "texts", compression="zstd")
        shared = shared.join(texts.select("id", F.length("text").alias("weight")), "id")
        large = shared.groupBy("bucket").agg(_blocks(F.count(F.lit(1)), F.sum("weight"), most).alias("blocks")).where("blocks > 1")
        large = shelf.put(large, "large")
        block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1)))
        sets = shared.join(large, "bucket", "left").withColumn("block", block).repartition("bucket", "block").groupBy("bucket", "block")
        sets = sets.agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
        units = sets.groupBy("ids").agg(F.min(_band("bucket")).alias("band")).withColumn("unit", F.monotonically_increasing_id())
        units = shelf.put(units, "units", compression="zstd")
        alone = units.select("unit", "band", F.explode("ids").alias("id")).join(texts, "id")
        links = shelf.put(_unit_links(alone.select("*", F.col("id").alias("label"), F.lit(2).alias("side")), link, check), "links")
        groups = components(links)
        if not large.isEmpty():
            more = shelf.put(_unit_links(_across(shelf, shared.join(large, "bucket"), groups, most).join(texts, "id"), link, check), "more")
            groups = components(links.unionByName(more))
        return groups


def _contracted(links: DataFrame) -> DataFrame:
    """For each task's links: (a, b) from each node to the least one that the task's links join it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if not parts:
            return
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root, (a, b) = np.arange(len(nodes)), at.reshape(2, -1)
        while True:  # hook the greater root to the lesser, then point all nodes at their roots
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield batch_of({"a": nodes[moved], "b": nodes[root[moved]]}, {})

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, each: int = LINKS) -> DataFrame:
    """(node, root) for every node of links (a, b) that is joined to a lesser one: the least node that it is joined to.

    Each task contracts about `each` links to stars. Where there are more, large-star and small-star steps join the
    stars of different tasks, until every node points at its root. What a step makes is written to the shared
    folder, so lineage and memory stay bounded; the step before is deleted.
    """
    with Shelf(links.sparkSession) as shelf:
        found = shelf.put(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        before, turn, last = None, 0, "links"
        while True:
            n = found.count()
            tasks = max(1, -(-n // each))
            found = shelf.put(_contracted(found.coalesce(tasks)), f"stars{turn}")
            shelf.drop(last)
            last = f"stars{turn}"
            now = None if tasks == 1 else found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if tasks == 1 or now == before:
                return stored(found.select(F.col("a").alias("node"), F.col("b").alias("root")), "groups")
            before = now
            both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = shelf.put(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            found = shelf.put(small.where("a <> b").distinct(), f"small{turn}")
            shelf.drop(last, "large")
            last, turn = f"small{turn}", turn + 1
