"""Buckets of shared features: rows that share a bucket are compared by small sketches, likely pairs go on to be verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small, spanning_pairs

#: Bucket rows dealt to a task on average (a fraction of them if they carry content), rows whose buckets are walked at a
#: time, and pairs looked at in one step.
TASK_ROWS, CONTENT_ROWS, PART, STEP = 1 << 20, 1 << 17, 1 << 18, 1 << 19
#: A bucket with more than this share of a task's rows is split over tasks; rows that a task holds before it looks for such.
HOT_SHARE, HOLD = 16, 1 << 22
#: Pairs that a task remembers to have refused.
REFUSED = 1 << 20
#: A bucket key holds 48 bits of hash, then a row's size, 65,535 standing for all that are as large or larger.
SIZE_BITS = 16
MOST_SIZE = (1 << SIZE_BITS) - 1
#: Rows of a bucket from which its pairs are sought by walking the trie of their first sketch, if ``budget`` allows it.
LARGE = 1024


def mixed(h):
    """A bijection of uint64 that spreads every bit over all."""
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def bucket_keys(hashes, sizes):
    """Signed keys of buckets from uint64 ``hashes`` and the sizes of the rows that they stand for."""
    import numpy as np

    return ((hashes & ~np.uint64(MOST_SIZE)) | np.minimum(sizes, MOST_SIZE).astype(np.uint64)).view(np.int64)


def minima(hashes, starts, count: int):
    """``(len(starts), count)`` minima of runs of well mixed feature hashes under as many hash functions.

    Two sets of Jaccard similarity s share one with probability ``1 - (1 - s) ** count``. No run is empty.
    """
    import numpy as np

    odd = np.random.default_rng(5).integers(0, 1 << 64, count, dtype=np.uint64) | np.uint64(1)
    return np.stack([np.minimum.reduceat(hashes * o, starts) for o in odd], axis=1) if len(starts) else np.zeros((0, count), np.uint64)


def bucket_links(rows: DataFrame, count: int, near: Callable, least: float, sketches: int, budget: Callable | None = None, grouped: bool = False, test: Callable | None = None, buckets_of: Callable | None = None) -> DataFrame:
    """``(a, b)``: per task a spanning forest of the likely pairs of ``rows(key, rep, w0, w1, ...)`` that share a bucket.

    A pair is likely if its sizes allow the similarity ``least`` and ``near(size_i, size_j, w_i, w_j)`` gives it a cost
    that is not negative; cheap pairs are taken first. With ``grouped`` all likely pairs whose column ``g`` differs are
    returned, not a forest; with ``test`` too, those of them that it passes by the words of their ``content`` and that unite
    two groups not yet united in the task. ``buckets_of`` tells the buckets of a list of contents: a pair is tested in the
    first bucket that it shares, and in no other. A row may stand in a bucket more than once.

    ``count`` is about the number of rows; it sets the number of tasks, so that a task holds a bounded share of them,
    sorts it in place and looks at pairs by the step. ``budget(size)`` tells how many bits ``w0`` of a likely pair may
    differ in where the longer side has that size. Where a large bucket's budget is small, the trie of ``w0`` is walked
    against itself, so that rows that differ by more are never paired.

    No task holds a bucket of any size: a task passes the rows of a bucket that outgrows a sixteenth of its share on
    unpaired, and ``split`` deals them in blocks, each pair of blocks whose sizes allow ``least`` to a task of its own.
    Which pairs are looked at is the same. The result is read from a written table.
    """
    import numpy as np
    import pyarrow as pa

    from .simhash import trie_links

    words = [f"w{k}" for k in range(sketches)]
    names = ["key", "rep", *words, *(["g"] if grouped else []), *(["content"] if test else [])]
    share = CONTENT_ROWS if test else TASK_ROWS
    most, hold = max(share // HOT_SHARE, 2), HOLD
    cores = rows.sparkSession.sparkContext.defaultParallelism

    def runs(size, first, last):
        """Index pairs of each bucket in steps; rows are sorted by bucket, then size."""
        at = np.repeat(np.arange(len(first)), last - first) << 24
        longest = np.where(size == MOST_SIZE, MOST_SIZE, np.floor(size / least + 1e-6).astype(np.int64))
        n = np.searchsorted(at | size, at | np.minimum(longest, MOST_SIZE), side="right") - np.arange(len(size)) - 1
        done = np.cumsum(n)
        lo = 0
        while lo < len(n):
            base = done[lo - 1] if lo else 0
            hi = max(int(np.searchsorted(done, base + STEP, side="right")), lo + 1)
            i = np.repeat(np.arange(lo, hi), n[lo:hi])
            yield i, i + 1 + np.arange(len(i)) - np.repeat(done[lo:hi] - n[lo:hi] - base, n[lo:hi])
            lo = hi

    def group_of(x):
        return x["block"] if "block" in x else x["key"] >> SIZE_BITS

    def candidates(x, size):
        bucket = group_of(x)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        last = np.r_[first[1:], len(bucket)]
        many = last - first > LARGE
        limit = np.array([budget(int(size[e - 1])) if budget else 64 for e in last[many]], dtype=np.int64)
        tries = np.flatnonzero(many)[limit <= 4]
        for k, bits in zip(tries, limit[limit <= 4], strict=True):
            s, e = first[k], last[k]
            sketch = x["w0"][s:e].view(np.uint64)
            order = np.argsort(sketch, kind="stable")
            for i, j in trie_links(sketch[order], sketch[order], int(bits), True):
                yield s + order[i], s + order[j]
        keep = np.ones(len(first), bool)
        keep[tries] = False
        if not keep.any():
            return
        own = np.flatnonzero(np.repeat(keep, last - first))
        width = (last - first)[keep]
        ends = np.cumsum(width)
        for i, j in runs(size[own], ends - width, ends):
            yield own[i], own[j]

    def likely(x, size):
        for i, j in candidates(x, size):
            short, long = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            some = (short >= least * long - 1e-6) & (x["rep"][i] != x["rep"][j])
            if grouped:
                some &= x["g"][i] != x["g"][j]
            if "half" in x:  # of two blocks the pairs between them; a block alone has half 2
                some &= (x["half"][i] != x["half"][j]) | (x["half"][i] == 2)
            i, j, short, long = i[some], j[some], short[some], long[some]
            cost = near(short, long, [x[w][i].view(np.uint64) for w in words], [x[w][j].view(np.uint64) for w in words])
            some = cost >= 0
            yield i[some], j[some], cost[some]

    def settled(x, size, up: dict[int, int], refused: set[tuple[int, int]]) -> list[tuple[int, int]]:
        rep, g = x["rep"].tolist(), x["g"].tolist()
        words: dict[int, list] = {}
        out = []

        def root(v: int) -> int:
            while v in up:
                v = up[v]
            return v

        place = {r: k for k, r in enumerate(rep)}
        own = dict(zip(place, buckets_of([x["content"][k] for k in place.values()]), strict=True))
        bucket = (x["key"] >> SIZE_BITS).tolist()

        def words_of(k: int) -> list:
            if rep[k] not in words:
                words[rep[k]] = x["content"][k].split()
            return words[rep[k]]

        for i, j, cost in likely(x, size):
            order = np.argsort(cost, kind="stable")
            for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
                a, b = root(g[p]), root(g[q])
                pair = (min(rep[p], rep[q]), max(rep[p], rep[q]))
                if a == b or pair in refused or min(own[rep[p]] & own[rep[q]], default=bucket[p]) != bucket[p]:
                    continue
                if test(words_of(p), words_of(q)):
                    up[max(a, b)] = min(a, b)
                    out.append(pair)
                elif len(refused) < REFUSED:
                    refused.add(pair)
        return out

    def walk(x, up, refused):
        rep, node = np.unique(x["rep"], return_inverse=True)
        size = x["key"] & MOST_SIZE
        if test:
            return np.array(settled(x, size, up, refused), np.int64).reshape(-1, 2).T
        if grouped:
            parts = [(node[i], node[j]) for i, j, _ in likely(x, size)]
            i, j = (np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in (0, 1))
        else:
            i, j = spanning_pairs(len(rep), ((node[i], node[j], c) for i, j, c in likely(x, size)))
        pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1) if len(i) else np.zeros((2, 0), np.int64)
        return rep[pairs]

    def shared(x, hot):
        """The rows that do not stand alone in their group, or whose group was passed on before."""
        group = group_of(x)
        order = np.argsort(group)
        same = group[order][1:] == group[order][:-1]
        some = np.zeros(len(group), bool)
        some[order] = np.r_[False, same] | np.r_[same, False]
        if len(hot):
            some |= np.isin(group, hot)
        return {c: v[some] for c, v in x.items()}

    def tidy(held, columns, hot=None):
        """The held rows by group, size and row, each once; with ``hot``, groups passed on before, no others that stand alone."""
        x = {c: np.concatenate([h[c] for h in held]) for c in columns}
        if hot is not None:
            x = shared(x, hot)
        group = group_of(x)
        order = np.lexsort((x["rep"], x["key"], group))
        group, key, rep = group[order], x["key"][order], x["rep"][order]
        order = order[np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]) | (rep[1:] != rep[:-1])][: len(order)]]
        return {c: v[order] for c, v in x.items()}

    def outgrown(x, before):
        """Whether each row's bucket has more rows than a task may pair, or had so before."""
        bucket = group_of(x)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        width = np.diff(np.r_[first, len(bucket)])
        over = (width > most) | np.isin(bucket[first], before)
        return np.repeat(over, width), np.union1d(before, bucket[first[over]])

    def linked(x):
        """Pairs of the groups of a tidy table, some groups at a time."""
        group = group_of(x)
        width = np.diff(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)])
        rows = np.flatnonzero(np.repeat(width > 1, width))  # rows alone in their bucket link with nothing
        group = group[rows]
        up: dict[int, int] = {}
        refused: set[tuple[int, int]] = set()
        at = 0
        while at < len(rows):
            to = min(at + PART, len(rows))
            to = int(np.searchsorted(group, group[to - 1], side="left")) if to < len(rows) else to
            if to <= at:  # one group is larger than a part
                to = int(np.searchsorted(group, group[at], side="right"))
            yield walk({c: v[rows[at:to]] for c, v in x.items()}, up, refused)
            at = to

    passed = [("key", pa.int64()), *((w, pa.int64()) for w in words), *([("g", pa.int64())] if grouped else []), *([("content", pa.binary())] if test else [])]

    def links_out(pairs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *(pa.nulls(len(pairs[0]), kind) for _, kind in passed)], names=["a", "b", *(c for c, _ in passed)])

    def rows_out(x, some) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(some)
        for s in range(0, len(at), 1 << 16):
            r = at[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x["rep"][r], pa.int64()), pa.nulls(len(r), pa.int64()), *(pa.array(x[c][r], kind) for c, kind in passed)], names=["a", "b", *(c for c, _ in passed)])

    def joined(columns, splits: bool):
        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, wait, hot = [], 0, hold, np.zeros(0, np.int64)
            for y in batches:
                if not y.num_rows:
                    continue
                held.append({c: y.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(columns)})
                n += y.num_rows
                if splits and n > wait:
                    x = tidy(held, columns)
                    over, hot = outgrown(x, hot)
                    yield from rows_out(x, over)
                    held = [{c: v[~over] for c, v in x.items()}]
                    n = len(held[0]["key"])
                    wait = max(hold, 2 * n)
            if not n:
                return
            x = tidy(held, columns, hot)
            held.clear()
            if not len(x["key"]):
                return
            if splits:
                over, hot = outgrown(x, hot)
                yield from rows_out(x, over)
                x = {c: v[~over] for c, v in x.items()}
            for pairs in linked(x):
                yield links_out(pairs)

        return join

    kinds = {"key": "long", "g": "long", "content": "binary"} | dict.fromkeys(words, "long")
    schema = ", ".join(["a long", "b long", *(f"{c} {kinds[c]}" for c, _ in passed)])
    dealt = rows.select(*names).repartition(max(cores, -(-count // share)), F.shiftright("key", SIZE_BITS))
    out = cut(dealt.mapInArrow(joined(names, True), schema))
    links = out.where("b IS NOT NULL").select("a", "b")
    over = out.where("b IS NULL").withColumnRenamed("a", "rep")
    if not over.limit(1).count():
        return links.distinct()
    blocks = split(over, most, least)
    again = blocks.select(*names, "block", "half").repartition(max(cores, -(-blocks.count() // share)), "block")
    return links.unionByName(again.mapInArrow(joined([*names, "block", "half"], False), schema).select("a", "b")).distinct()


def split(over: DataFrame, most: int, least: float) -> DataFrame:
    """The rows of large buckets once for each pair of blocks that they are compared in: ``block`` names the pair, ``half``
    the side, 2 where a block is compared with itself.

    A bucket's rows are cut into classes by size, such that rows of similarity ``least`` stand in one class or two
    neighbours, and a class by hash into blocks of at most about half of ``most`` rows. Only counts by bucket and class
    are gathered, of which a bucket has some fifty.
    """
    bucket, size = F.shiftright("key", SIZE_BITS), F.col("key").bitwiseAND(F.lit(MOST_SIZE))
    rows = over.withColumn("bucket", bucket).withColumn("class", F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(1 / least)) + 1e-9).cast("int"))
    counts = rows.groupBy("bucket", "class").agg(F.ceil(F.count("*") / F.lit(max(most // 2, 1))).cast("int").alias("n"))
    per = cut(counts.groupBy(F.col("bucket").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("parts")))
    rows = rows.join(small(per, 512), F.col("bucket") == F.col("of"))
    own = F.pmod(F.xxhash64("rep"), F.col("parts")[F.col("class")]).cast("int")

    def pairs(other, here_first: bool):
        """The blocks of a neighbouring class, each with this row's block."""
        n = F.coalesce(F.col("parts")[other], F.lit(0))
        named = lambda j: F.struct(*((F.col("class"), F.col("own"), other, j) if here_first else (other, j, F.col("class"), F.col("own"))))
        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda j: j < n), lambda j: F.struct(F.xxhash64("bucket", named(j)).alias("block"), F.lit(0 if here_first else 1).alias("half")))

    def inside(j):
        low, high = F.least("own", j), F.greatest("own", j)
        half = F.when(j == F.col("own"), 2).when(F.col("own") < j, 0).otherwise(1)
        return F.struct(F.xxhash64("bucket", F.struct("class", low, F.col("class"), high)).alias("block"), half.alias("half"))

    n = F.col("parts")[F.col("class")]
    among = F.transform(F.sequence(F.lit(0), n - 1), inside)
    dealt = F.concat(among, pairs(F.col("class") + 1, True), pairs(F.col("class") - 1, False))
    return cut(rows.withColumn("own", own).withColumn("at", F.explode(dealt)).select(*over.columns, F.col("at.block").alias("block"), F.col("at.half").alias("half")))


def banded_groups(rows: Callable[[DataFrame | None], DataFrame], count: int, each: int, verified: Callable[[DataFrame], DataFrame], test: Callable | None = None, buckets_of: Callable | None = None, **how) -> DataFrame:
    """``(node, component)`` of the rows that verified pairs unite.

    ``rows(None)`` gives the bucket rows of all ``count`` rows, about ``each`` of one; ``rows(nodes)`` those of the written
    ``nodes(node, g)`` with their column ``g``.
    ``verified`` turns ``(a, b)`` into a written ``(a, b, same)``. A link of the forest that fails leaves its two sides
    apart, though another pair between them may pass. So in clusters with a failed link all likely pairs whose sides are
    still apart are verified too: where they are found if ``test`` compares the ``content`` of rows, else by ``verified``.
    """
    forest = cut(bucket_links(rows(None), count * each, **how))
    found = verified(forest)
    groups = cut(components(found.where("same").select("a", "b")))
    failed = cut(found.where("NOT same").select("a", "b"))
    if not failed.count():
        return groups
    ends = forest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sides = cut(ends.join(small(groups.select(F.col("node").alias("g_node"), "component"), 16), F.col("node") == F.col("g_node"), "left").select("node", F.coalesce("component", "node").alias("g")))
    torn = failed.select(F.explode(F.array("a", "b")).alias("end")).distinct().join(sides, F.col("end") == F.col("node")).select(F.col("g").alias("torn")).distinct()
    apart = cut(sides.join(small(cut(torn), 8), F.col("g") == F.col("torn"), "left_semi"))
    again = bucket_links(rows(apart), apart.count() * each, grouped=True, test=test, buckets_of=buckets_of, **how)
    if test:
        again = cut(again)
    else:
        again = verified(cut(again.join(failed, ["a", "b"], "left_anti"))).where("same").select("a", "b")
    side = lambda c: apart.select(F.col("node").alias(c), F.col("g").alias(f"g_{c}"))
    joined = cut(components(again.join(side("a"), "a").join(side("b"), "b").select(F.col("g_a").alias("a"), F.col("g_b").alias("b"))))
    moved = sides.join(small(joined.select(F.col("node").alias("old"), F.col("component").alias("new")), 16), F.col("g") == F.col("old"), "left")
    return cut(moved.select("node", F.coalesce("new", "g").alias("component")))
