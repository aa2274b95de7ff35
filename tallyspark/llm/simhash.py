"""Operator 3: SimHash near-duplicates by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bands import banded_groups, bucket_keys, minima, mixed
from .common import components, cut, local_forest, small, table

CHUNK = 1 << 16
SQUARE = 512
#: The pipeline's stage: bits within which SimHashes link, similarity of five-word shingle sets, bits that candidates of
#: the MinHash bands may differ in, and these bands.
STAGE_LINK, STAGE_JACCARD, STAGE_BITS = 2, 0.8, 22
BANDS, BAND_ROWS = 20, 5


def fingerprint(text: str | None, shingle_words: int) -> int:
    """64-bit SimHash of the A-Z-lower-cased word shingles; zero for null, empty or blank text."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hash_of, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle_words:
        return hash_of(joined, 42)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    begin, end = (end - length)[: len(words) - shingle_words + 1].tolist(), end[shingle_words - 1 :].tolist()
    hashes = np.array([hash_of(joined[s:e], 42) for s, e in zip(begin, end, strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``(id_col, fp long)`` for every row; the fingerprint's bits are kept in a signed long."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle_words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f - (1 << 64) if f >> 63 else f for f in fps], pa.int64())], names=[id_col, "fp"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} long, fp long")


def rotations(budget: int) -> list[tuple[int, int]]:
    """``(rotation, top bits)`` for ``budget + 1`` blocks of the 64 bits.

    Two fingerprints within the budget agree on a whole block, so rotated by its start they share a trie node as
    deep as the block is long.
    """
    cuts = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [(s, e - s) for s, e in zip(cuts, cuts[1:], strict=False)]


def trie_links(a, b, budget: int, same: bool, most: int = 1 << 18, top: int = 0):
    """Index pairs ``(i of a, j of b)`` at ``budget`` or fewer differing bits, in chunks; ``a`` and ``b`` are sorted uint64.

    Node pairs are walked level by level with the bits they already differ in; a pair over the budget or with an
    empty side is dropped. Small node pairs are finished by comparing their members. ``same`` joins a set with
    itself and gives each pair once. With ``top`` the walk starts at the pairs of equal nodes ``top`` bits deep.
    """
    import numpy as np

    if not len(a) or not len(b):
        return
    one = np.uint64(1)
    low = np.array([0], np.int64), np.array([len(a)], np.int64), np.array([0], np.int64), np.array([len(b)], np.int64)
    if top:
        nodes, begin = np.unique(a >> np.uint64(64 - top), return_index=True)
        end = np.append(begin[1:], len(a))
        other = b >> np.uint64(64 - top)
        low = begin, end, np.searchsorted(other, nodes), np.searchsorted(other, nodes, side="right")
        some = (low[3] > low[2]) & ((end - begin > 1) | (not same))
        low = tuple(x[some].astype(np.int64) for x in low)
    todo = [(top, *low, np.zeros(len(low[0]), np.int64))]
    while todo:
        depth, al, ah, bl, bh, spent = todo.pop()
        if len(al) > most:
            todo += [(depth, *(x[k : k + most] for x in (al, ah, bl, bh, spent))) for k in range(0, len(al), most)]
            continue
        product = (ah - al) * (bh - bl)
        if depth == 64:  # equal members: large nodes are compared in squares
            for k in np.flatnonzero(product > most).tolist():
                for x in range(al[k], ah[k], SQUARE):
                    for y in range(max(bl[k], x) if same else bl[k], bh[k], SQUARE):
                        i, j = (v.ravel() for v in np.meshgrid(np.arange(x, min(x + SQUARE, ah[k])), np.arange(y, min(y + SQUARE, bh[k])), indexing="ij"))
                        yield (i[i < j], j[i < j]) if same else (i, j)
            al, ah, bl, bh, spent = (x[product <= most] for x in (al, ah, bl, bh, spent))
            product = product[product <= most]
        done = (product <= 32) | (depth == 64)
        if done.any():
            x0, x1, y0, y1 = al[done], ah[done], bl[done], bh[done]
            width, size = y1 - y0, (x1 - x0) * (y1 - y0)
            step = most // 8 if depth < 64 else 4
            for s in range(0, len(size), step):
                e = min(s + step, len(size))
                n = size[s:e]
                at = np.repeat(np.arange(s, e), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, j = x0[at] + k // width[at], y0[at] + k % width[at]
                near = (np.bitwise_count(a[i] ^ b[j]) <= budget) & ((i < j) if same else True)
                if near.any():
                    yield i[near], j[near]
            al, ah, bl, bh, spent = (x[~done] for x in (al, ah, bl, bh, spent))
        if not len(al):
            continue
        bit = one << np.uint64(63 - depth)
        above = ~((bit << one) - one) if depth else np.uint64(0)
        am = np.clip(np.searchsorted(a, (a[al] & above) | bit), al, ah)
        bm = np.clip(np.searchsorted(b, (b[bl] & above) | bit), bl, bh)
        parts = [(al, am, bl, bm, spent), (am, ah, bm, bh, spent), (al, am, bm, bh, spent + 1), (am, ah, bl, bm, spent + 1)]
        if same:  # of two mirrored node pairs the one with the larger left side is dropped
            mirror = (al == bl) & (ah == bh)
            parts[3] = tuple(x[~mirror] for x in parts[3])
        grown = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (grown[0] < grown[1]) & (grown[2] < grown[3]) & (grown[4] <= budget)
        if keep.any():
            todo.append((depth + 1, *(x[keep] for x in grown)))


def hamming_forest(reps: DataFrame, budget: int, test=None, columns: tuple[str, ...] = ()) -> DataFrame:
    """``(a, b)``: a spanning forest, per task, of the links within the budget between rows of ``reps(fp, rep)``.

    ``test(values, i, j)`` may refuse pairs by further ``columns`` of long values.

    Each fingerprint goes, once per rotation, to the task that holds its node at the rotation's depth. A task
    walks the tries below its nodes against themselves, a run of nodes at a time, and unites what it links.
    Every link within the budget joins its two ends in the united forests. A task holds 16 bytes and the further
    columns for each row of a node. Rows with a null ``rep`` are left out.
    """
    import numpy as np
    import pandas as pd

    turns = rotations(budget)
    depth = [d for _, d in turns]
    turned = lambda r: F.shiftleft("fp", r).bitwiseOR(F.shiftrightunsigned("fp", 64 - r)) if r else F.col("fp")
    node = lambda r, d: F.shiftrightunsigned(turned(r), 64 - d)
    copies = F.array(*(F.struct(F.lit(k).alias("turn"), node(r, d).alias("node"), turned(r).alias("bits")) for k, (r, d) in enumerate(turns)))
    routed = reps.where("rep is not null").select("rep", *(F.col(c).cast("long").alias(c) for c in columns), F.explode(copies).alias("c")).select("c.turn", "c.node", "c.bits", "rep", *columns).repartition("turn", "node").sortWithinPartitions("turn", "node", "bits")

    def walk(turn: int, rows: pd.DataFrame) -> pd.DataFrame:
        bits = rows["bits"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(bits, kind="stable")
        bits, rep = bits[order], rows["rep"].to_numpy(np.int64)[order]
        values = {c: rows[c].to_numpy(np.int64)[order] for c in columns}
        links = trie_links(bits, bits, budget, True, top=depth[turn])
        if test:
            links = ((i[ok], j[ok]) for i, j in links for ok in (test(values, i, j),))
        label = local_forest(len(rep), links)
        own = np.flatnonzero(label != np.arange(len(rep)))
        return pd.DataFrame({"a": rep[own], "b": rep[label[own]]})

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of a node that may go on in the next part
        for pdf in parts:
            if not len(pdf):
                continue
            last = (pdf["turn"] == pdf["turn"].iloc[-1]) & (pdf["node"] == pdf["node"].iloc[-1])
            if last.all() and held and tuple(held[-1].iloc[-1][["turn", "node"]]) == tuple(pdf.iloc[-1][["turn", "node"]]):
                held.append(pdf)
                continue
            done = pd.concat([*held, pdf[~last]])
            held = [pdf[last]]
            first = tuple(held[0].iloc[0][["turn", "node"]])
            more = (done["turn"] == first[0]) & (done["node"] == first[1])
            if more.any():
                held.insert(0, done[more])
                done = done[~more]
            for turn, rows in done.groupby("turn"):
                yield walk(int(turn), rows)
        for turn, rows in pd.concat(held).groupby("turn") if held else ():
            yield walk(int(turn), rows)

    return routed.mapInPandas(join, "a long, b long")


def link_components(fps: DataFrame, budget: int = 2) -> DataFrame:
    """``(fp, component_id)`` for the distinct fingerprints of a written ``(id, fp)`` table.

    Copies meet first: one row per fingerprint with its smallest id, however many copies a text has.
    """
    reps = cut(fps.groupBy("fp").agg(F.min(fps.columns[0]).alias("rep")))
    roots = components(hamming_forest(reps, budget))
    return cut(reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, budget: int = 2) -> DataFrame:
    """``(id_col, fingerprint hex, component_id)`` for every row of ``docs``.

    Null, empty and blank texts have fingerprint zero, which links like any other. Long texts are read whole.
    Repeated rows are returned as often as they stand. Rows with a null id keep their fingerprint and take the
    component of their fingerprint's smallest id, null if it has none. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle_words))
    comp = link_components(fps, budget)
    return fps.join(comp, "fp", "left").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, shingle_words: int):
    """``(hash of the words, sorted distinct shingle hashes)`` of the A-Z-lower-cased text; zero and none for a blank one."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0, np.array([], dtype="<u8")
    n = max(len(words) - shingle_words + 1, 1)
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle_words]), 42) for k in range(n)], dtype="<u8")
    return xxhash.xxh3_64_intdigest(b" ".join(words)), np.unique(hashes)


def shingle_sketches(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """``(id, text_hash, kind, sim, size, keys)`` for every row: texts of equal words share a kind, ``size`` counts distinct shingles.

    ``keys`` are the row's buckets, one for each band of ``BAND_ROWS`` MinHashes.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                y = b.slice(s, 256)
                texts = y.column(2).to_pylist()
                parts = [shingle_hashes(t, shingle_words) for t in texts]
                sims = np.array([fingerprint(t, shingle_words) for t in texts], dtype=np.uint64).view(np.int64)
                kinds = np.array([k for k, _ in parts], dtype=np.uint64).view(np.int64)
                sizes = np.array([len(h) for _, h in parts], dtype=np.int64)
                runs = np.concatenate([h if len(h) else np.zeros(1, "<u8") for _, h in parts])
                count = np.maximum(sizes, 1)
                low = minima(runs, np.cumsum(count) - count, BANDS * BAND_ROWS).reshape(-1, BANDS, BAND_ROWS)
                key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(texts), 1))
                for r in range(BAND_ROWS):
                    key = mixed(key ^ low[:, :, r])
                keys = bucket_keys(key, np.repeat(sizes[:, None], BANDS, axis=1))
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([y.column(0), y.column(1), pa.array(kinds), pa.array(sims), pa.array(sizes, pa.int32()), lists], names=["id", "text_hash", "kind", "sim", "size", "keys"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("t")).mapInArrow(run, "id long, text_hash long, kind long, sim long, size int, keys array<long>")


def jaccard_verified(pairs: DataFrame, docs: DataFrame, kinds: DataFrame, shingle_words: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """``(a, b, same)`` for pairs of kinds: whether the Jaccard similarity of their shingle sets reaches ``least``."""
    import pyarrow as pa

    asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("kind")).distinct().join(kinds.select("kind", "rep_id"), "kind").select(F.col("rep_id").alias("__id")).distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).join(small(asked, 16), F.col("id") == F.col("__id")).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                parts = [shingle_hashes(t, shingle_words) for t in b.column(0).slice(s, 256).to_pylist()]
                kind = [k - (1 << 64) if k >> 63 else k for k, _ in parts]
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array([h.view("<i8") for _, h in parts], pa.list_(pa.int64()))], names=["kind", "shingles"])

    sets = cut(texts.mapInArrow(run, "kind long, shingles array<long>").dropDuplicates(["kind"]))
    left, right = (sets.select(F.col("kind").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", (both >= least * (F.size("set_a") + F.size("set_b") - both) - 1e-9).alias("same")))


def keep_one(docs: DataFrame, shingle_words: int = 5, budget: int = STAGE_BITS, least: float = STAGE_JACCARD, id_col: str = "doc_id", text_col: str = "text", link: int = STAGE_LINK) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; all columns stay.

    Texts whose SimHashes differ in at most ``link`` bits are linked by the tries of operator 3, all of them. Beside these,
    texts with a Jaccard similarity of ``least`` or more over word shingles are linked: candidates share a MinHash band and
    differ in at most ``budget`` bits of their SimHashes; the similarity is verified on the texts. Components are of both. Blank texts
    are copies of one another. Each row is judged by its own text: of rows with one id and different texts those go whose
    component has a smaller id, and the others stay. Rows without an id stay.
    """
    import numpy as np

    rows = cut(shingle_sketches(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle_words))
    kinds = cut(rows.groupBy("kind").agg(F.min("id").alias("rep_id"), F.min("sim").alias("sim"), F.min("size").alias("size"), F.min("keys").alias("keys")))

    def buckets(nodes: DataFrame | None) -> DataFrame:
        some = kinds.where("size > 0")
        if nodes is not None:
            some = some.join(small(nodes, 16), F.col("kind") == F.col("node"))
        return some.select(F.explode("keys").alias("key"), F.col("kind").alias("rep"), F.col("sim").alias("w0"), *(["g"] if nodes is not None else []))

    def near(short, long, a, b):
        bits = np.bitwise_count(a[0] ^ b[0]).astype(np.int64)
        return np.where(bits <= budget, bits, -1)

    groups = banded_groups(buckets, kinds.count(), BANDS, lambda pairs: jaccard_verified(pairs, docs, kinds, shingle_words, least, id_col, text_col), near=near, least=least, sketches=1)
    near_by = link_components(kinds.where("size > 0").select("kind", F.col("sim").alias("fp")), link).where("component_id IS NOT NULL")
    tries = kinds.where("size > 0").join(near_by, F.col("sim") == F.col("fp")).select(F.col("kind").alias("a"), F.col("component_id").alias("b"))
    groups = cut(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(tries)))
    linked = cut(kinds.select("kind", "rep_id").join(groups, F.col("kind") == F.col("node"), "left").select("kind", "rep_id", F.coalesce("component", "kind").alias("group")))
    firsts = linked.groupBy("group").agg(F.min("rep_id").alias("first"))
    of_kind = linked.join(firsts, "group").select("kind", "first")
    gone = rows.select("id", "text_hash", "kind").distinct().join(of_kind, "kind").where("first <> id")
    gone = cut(gone.select(F.col("id").alias("__gone"), F.col("text_hash").alias("__text")).distinct())
    same = (docs[id_col].cast("long") == gone["__gone"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["__text"])
    return docs.join(gone, same, "left_anti")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
