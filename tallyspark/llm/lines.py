"""Operator 1: fuzzy line dedup by blocks of words, SimHash, edit similarity and connected groups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bands import SIZE_BITS, banded_groups, bucket_keys, minima, mixed
from .common import BROADCAST_BYTES, cut, small, table

#: Normalisation: A-Z (and what ``str.lower`` lowers) in lower case, digits as they stand, other ASCII punctuation as space.
NORMAL = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 else 32 for b in range(256))
KEEP_BREAKS = NORMAL[:10] + b"\n" + NORMAL[11:]
MIN_WORDS = 1
SIMILARITY = 0.8
#: Lines of up to ``SHORT`` words meet in all their blocks of two words, lines of ``LONG`` or more in so many MinHashes of
#: their blocks of three. At the default similarity lines of 13 words or more only go with lines of 11 or more.
SHORT, LONG, HASHES = 12, 11, 10
#: Sketches of two words of 64 bits: two bags up to ``BAG_ONLY`` words, a bag and a SimHash up to ``BAG_TOO``, two SimHashes
#: of longer lines, whose bags would be full. Bits that one SimHash of similar lines may differ in, and two.
BAG_ONLY, BAG_TOO, MAX_BITS, MAX_BITS_2 = 16, 32, 22, 38
#: Weight in the SimHash of words of so many bytes or more, others count once: unlike lines share mostly short words.
HEAVY, HEAVY_BYTES = 4, 4
#: Bytes of text that a worker hashes at once.
PART_BYTES = 1 << 19


def normal_words(line: str) -> list[bytes]:
    return line.lower().encode("utf-8", "replace").translate(NORMAL).split()


_powers: list = []


def powers(n: int):
    """The first ``n`` powers (or more) of a fixed odd number and of its inverse, modulo 2 ** 64."""
    import numpy as np

    if not _powers or len(_powers[0]) <= n:
        base = 0x9E3779B97F4A7C15
        size = max(1 << 16, 1 << n.bit_length())
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64))]
    return _powers


def run_hashes(values, starts, ends):
    """A 64-bit hash of each run ``values[start:end]`` of uint64 numbers: a polynomial, cut out of one running sum."""
    import numpy as np

    up, down = powers(len(values))
    sums = np.r_[np.uint64(0), np.cumsum(values * up[: len(values)])]
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: bytes, starts, sizes):
    """A 64-bit hash of each word ``raw[start:start + size]``, eight bytes at a time; ``raw`` ends in eight spare bytes."""
    import numpy as np
    import xxhash

    windows = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = windows[starts] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(sizes, 8)).astype(np.uint64)))
    at = np.flatnonzero(sizes > 8)
    k = 8
    while len(at) and k < 64:
        left = np.minimum(sizes[at] - k, 8).astype(np.uint64)
        out[at] = mixed(out[at]) ^ (windows[starts[at] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)))
        k += 8
        at = at[sizes[at] > k]
    for j in at.tolist():
        out[j] = xxhash.xxh3_64_intdigest(raw[starts[j] : starts[j] + sizes[j]])
    return mixed(out + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashed_lines(texts: list[bytes]):
    """``(words, heavy, sizes, kinds, doc, line)`` of lower-cased texts, for their lines that have words.

    words: hashes of the normal words, line after line; heavy: whether a word is long; sizes: words of each line;
    kinds: hash of its words; doc, line: index of the text and number of the line in it.
    """
    import numpy as np

    normal = [t.translate(KEEP_BREAKS) for t in texts]
    raw = b"\n" + b"\n".join(normal) + b"\n"
    seen = np.frombuffer(raw, np.uint8)
    word = (seen != 32) & (seen != 10)
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    words, heavy = word_hashes(raw + b"\0" * 8, starts, lengths), lengths >= HEAVY_BYTES
    breaks = np.flatnonzero(seen == 10)
    sizes = np.diff(np.searchsorted(starts, breaks))
    per = np.fromiter((t.count(b"\n") + 1 for t in normal), np.int64, len(normal))
    doc = np.repeat(np.arange(len(normal)), per)
    line = np.arange(len(sizes)) - np.repeat(np.cumsum(per) - per, per)
    some = sizes > 0
    sizes, doc, line = sizes[some], doc[some], line[some]
    ends = np.cumsum(sizes)
    return words, heavy, sizes, run_hashes(words, ends - sizes, ends), doc, line


#: Of a byte, its eight bits in eight lanes of a uint64.
LANES = [sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)]


def simhashes(hashes, sizes, weights):
    """SimHash of each run of ``sizes`` word hashes; a bit is 1 if set in over half the weight, at most ``HEAVY`` a word."""
    import numpy as np

    if not len(sizes):
        return np.zeros(0, np.uint64)
    lanes, step = np.array(LANES, dtype=np.uint64), 255 // HEAVY  # lanes of eight bits hold the sums of so many words
    parts = -(-sizes // step)
    starts = np.cumsum(sizes) - sizes
    cuts = np.repeat(starts, parts) + step * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    raw = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.empty((len(sizes), 8, 8), np.int64)
    for k in range(8):
        counts = np.add.reduceat(lanes[raw[:, k]] * weights, cuts).view(np.uint8).reshape(-1, 8)
        ones[:, k] = np.add.reduceat(counts, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    set_bits = (2 * ones.reshape(-1, 64) > np.add.reduceat(weights.astype(np.int64), starts)[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()


def sketches(words, sizes, heavy):
    """``(w0, w1)`` of each line: bags with a bit for each word or SimHashes, by the line's length."""
    import numpy as np

    starts = np.cumsum(sizes) - sizes
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    weights = np.where(heavy, np.uint64(HEAVY), np.uint64(1))
    bag = lambda shift: np.bitwise_or.reduceat(np.uint64(1) << ((words >> np.uint64(shift)) & np.uint64(63)), starts)
    w0, w1, long = bag(0), np.where(sizes <= BAG_ONLY, bag(20), simhashes(words, sizes, weights)), sizes > BAG_TOO
    here = np.repeat(long, sizes)
    w0[long] = simhashes(mixed(words[here]), sizes[long], weights[here])
    return w0, w1


def bucket_rows(words, sizes, kinds):
    """``(key, row)``: the buckets of each line and its index."""
    import numpy as np

    ends = np.cumsum(sizes)
    starts = ends - sizes
    run = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(words))  # words from here to the line's end
    two = mixed(words * np.uint64(3) + np.r_[words[1:], np.zeros(min(1, len(words)), np.uint64)])
    at = np.flatnonzero((left >= 2) & (sizes[run] >= 4) & (sizes[run] <= SHORT))
    keys, rows = [bucket_keys(mixed(two[at]), sizes[run[at]])], [run[at]]
    long = np.flatnonzero(sizes >= LONG)
    if len(long):
        three = mixed(two * np.uint64(5) + np.r_[words[2:], np.zeros(min(2, len(words)), np.uint64)])
        inside = left >= 3
        inside &= (sizes >= LONG)[run]
        first = np.cumsum(sizes[long] - 2) - (sizes[long] - 2)
        low = minima(three[inside], first, HASHES)
        for k in range(HASHES):
            keys.append(bucket_keys(mixed(low[:, k] + np.uint64(k + 1)), sizes[long]))
            rows.append(long)
    return np.concatenate(keys), np.concatenate(rows)


def parts_of(batch, most: int = PART_BYTES):
    """``(row numbers, lower-cased bytes)`` of the non-empty texts of an Arrow column, some megabytes at a time."""
    rows, texts, size = [], [], 0
    for k, t in enumerate(batch.to_pylist()):
        if not t:
            continue
        rows.append(k)
        texts.append(t.lower().encode("utf-8", "replace"))
        size += len(texts[-1])
        if size >= most:
            yield rows, texts
            rows, texts, size = [], [], 0
    if texts:
        yield rows, texts


def line_buckets(texts: DataFrame, min_words: int) -> DataFrame:
    """``(key, rep, w0, w1)`` for the buckets of every line of the single column of ``texts``.

    ``rep`` is the hash of the normal line. A worker leaves out a line that it has just seen, so that a frequent line
    costs a few rows of each task.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.uint64)
        for b in batches:
            for _, part in parts_of(b.column(0)):
                words, heavy, sizes, kinds, _, _ = hashed_lines(part)
                slot = (kinds & np.uint64(0xFFFF)).astype(np.int64)
                fresh = (sizes >= max(min_words, 4)) & (seen[slot] != kinds)
                seen[slot] = kinds
                first = np.zeros(len(kinds), bool)
                first[np.unique(kinds, return_index=True)[1]] = True
                fresh &= first
                here = np.repeat(fresh, sizes)
                words, heavy, sizes, kinds = words[here], heavy[here], sizes[fresh], kinds[fresh]
                key, row = bucket_rows(words, sizes, kinds)
                w0, w1 = sketches(words, sizes, heavy)
                for s in range(0, len(key), 1 << 16):
                    r = row[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[s : s + (1 << 16)]), *(pa.array(c[r].view(np.int64)) for c in (kinds, w0, w1))], names=["key", "rep", "w0", "w1"])

    return texts.mapInArrow(run, "key long, rep long, w0 long, w1 long")


def buckets_of(normal: list[bytes]) -> list[set[int]]:
    """The buckets of each normal line, without the sizes that their keys carry."""
    out: list[set[int]] = [set() for _ in normal]
    for s in range(0, len(normal), 4096):
        words, _, sizes, kinds, doc, _ = hashed_lines(normal[s : s + 4096])
        key, row = bucket_rows(words, sizes, kinds)
        for k, r in zip((key >> SIZE_BITS).tolist(), (doc[row] + s).tolist(), strict=True):
            out[r].add(k)
    return out


def lines_of(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_hash, line, kind)`` for each line with ``min_words`` or more normal words; lines are numbered from 0."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for rows, part in parts_of(b.column(2)):
                _, _, sizes, kinds, doc, line = hashed_lines(part)
                some = sizes >= min_words
                at = np.array(rows)[doc[some]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(hashes[at]), pa.array(line[some], pa.int32()), pa.array(kinds[some].view(np.int64))], names=["id", "text_hash", "line", "kind"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text), text.alias("t")).mapInArrow(run, "id long, text_hash long, line int, kind long")


def edit_distance(a: list, b: list, most: int | None = None) -> int:
    """Levenshtein distance of two word lists, bit-parallel over one of them after their common ends are cut.

    With ``most``, any number above it as soon as the distance is known to be larger.
    """
    a, b = trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    at: dict = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    full, high, up, down, score, gap = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a), len(a) - len(b)
    for k, w in enumerate(b, 1):
        x = at.get(w, 0) | down
        d = (((x & up) + up) ^ up) | x
        plus, minus = down | ~(up | d), up & d
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus = plus << 1 | 1
        up, down = (minus << 1 | ~(plus | d)) & full, plus & d & full
        if most is not None and not k & 7 and k + gap > 0:
            # distances never fall along the diagonal that ends in the last one; here is its one of ``k`` words of ``b``
            upto = (1 << (k + gap)) - 1
            if k + (up & upto).bit_count() - (down & upto).bit_count() > most:
                return most + 1
    return score if most is None else min(score, most + 1)


def trimmed(a: list, b: list) -> tuple[list, list]:
    """Two lists without what they begin and end with alike."""
    s = e = 0
    while s < len(a) and s < len(b) and a[s] == b[s]:
        s += 1
    while e < len(a) - s and e < len(b) - s and a[-1 - e] == b[-1 - e]:
        e += 1
    return a[s : len(a) - e], b[s : len(b) - e]


def similar(a: list, b: list, least: float) -> bool:
    """Whether the edit distance of two word lists is at most ``1 - least`` of the longer one's length."""
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > most or len(set(a).difference(b)) > most:
        return False
    a, b = trimmed(a, b)
    if max(len(a), len(b)) <= most:
        return True
    here, there = Counter(a), Counter(b)
    common = sum(min(n, there[w]) for w, n in here.items() if w in there)  # each word of the longer one beside these is an edit
    return max(len(a), len(b)) - common <= most and edit_distance(a, b, most) <= most


def line_texts(pairs: DataFrame, kinds: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(kind, line)``: the normal line of every kind of ``pairs``, from its first place; written.

    Where rows share an id, the line is taken from the one whose line is of the kind.
    """
    import numpy as np
    import pyarrow as pa

    asked = pairs.select(F.explode(F.array("a", "b")).alias("kind")).distinct().join(kinds.select("kind", "fid", "fline"), "kind")
    asked = cut(asked.groupBy(F.col("fid").alias("__fid")).agg(F.collect_list(F.struct("fline", "kind")).alias("asked")))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("t")).join(small(asked, 64), F.col("__id") == F.col("__fid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, found = [], []
            for t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                split = (t or "").lower().encode("utf-8", "replace").translate(KEEP_BREAKS).split(b"\n")
                for q in want:
                    if q["fline"] < len(split):
                        names.append(q["kind"])
                        found.append(b" ".join(split[q["fline"]].split()))
            _, _, _, kinds, at, _ = hashed_lines(found) if found else (None,) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64), None)
            asked_of = np.array(names, np.int64)[at]
            right = at[kinds.view(np.int64) == asked_of]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[right]), pa.array([found[k] for k in right.tolist()], pa.binary())], names=["kind", "line"])

    return cut(texts.select("t", "asked").mapInArrow(run, "kind long, line binary").groupBy("kind").agg(F.min("line").alias("line")))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, same)`` for pairs of kinds: whether the edit similarity over words of their lines reaches ``similarity``."""
    import pyarrow as pa

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            same = [similar(p.split(), q.split(), similarity) for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*x.columns[:2], pa.array(same, pa.bool_())], names=["a", "b", "same"])

    left, right = (texts.select(F.col("kind").alias(k), F.col("line").alias(f"line_{k}")) for k in "ab")
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "line_a", "line_b").mapInArrow(verify, "a long, b long, same boolean"))


def likely_lines(similarity: float, max_bits: int):
    """The cost of pairs of lines by their sketches, -1 where they cannot be (or, by SimHash, hardly are) similar.

    One edit changes at most two members of a line's set of words, so bags may differ in two bits for each allowed edit.
    """
    import numpy as np

    def near(short, long, a, b):
        most = 2 * np.floor((1 - similarity) * long + 1e-6)
        first, second = (np.bitwise_count(a[k] ^ b[k]).astype(np.int64) for k in (0, 1))
        bags = (first <= most) & np.where(long <= BAG_ONLY, second <= most, (short <= BAG_ONLY) | (second <= max_bits))
        hashes = np.where(short <= BAG_TOO, second <= max_bits, first + second <= MAX_BITS_2)
        return np.where(np.where(long <= BAG_TOO, bags, hashes), np.where(long <= BAG_ONLY, first, second), -1)

    return near


def groups_of_lines(docs: DataFrame, kinds: DataFrame, count: int, min_words: int, max_bits: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """``(node, component)`` of the kinds that verified pairs unite."""
    held: dict[str, DataFrame] = {}

    def rows(nodes: DataFrame | None) -> DataFrame:
        if nodes is None:
            return line_buckets(docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string")), min_words)
        texts = held["texts"].join(small(nodes, 16), F.col("kind") == F.col("node")).select("kind", "line", "g")
        again = line_buckets(texts.select(F.decode("line", "UTF-8")), min_words)
        return again.join(small(cut(texts), 400), F.col("rep") == F.col("kind")).select("key", "rep", "w0", "w1", "g", F.col("line").alias("content"))

    def verify(pairs: DataFrame) -> DataFrame:
        if "texts" not in held:
            held["texts"] = line_texts(pairs, kinds, docs, id_col, text_col)
        return verified(pairs, held["texts"], similarity)

    budget = lambda size: 2 * int((1 - similarity) * size + 1e-6) if size <= SHORT else 64
    test = lambda a, b: similar(a, b, similarity)
    return banded_groups(rows, count, HASHES, verify, test, buckets_of, near=likely_lines(similarity, max_bits), least=similarity, sketches=2, budget=budget)


def place(ident: str, line: str) -> Column:
    """Id and line as one number in their order, so that its minimum is found by hash aggregation."""
    return F.expr(f"cast({ident} AS decimal(19, 0)) * 2147483648BD + {line}")


def id_and_line(column: str, ident: str, line: str) -> tuple[Column, Column]:
    at = f"pmod({column}, 2147483648BD)"
    return F.expr(f"({column} - {at}) div 2147483648BD").alias(ident), F.expr(f"cast({at} AS int)").alias(line)


def lines_and_gone(docs: DataFrame, min_words: int = MIN_WORDS, max_bits: int = MAX_BITS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(lines, gone)``: all lines looked at, and ``(id, text_hash, line)`` of those that an earlier line of their group stands for.

    1. Equal normal lines meet in one kind with their first place (smallest id, then line).
    2. Kinds meet in blocks of words. With few edits one of the blocks between them stands unedited, which is the
       pigeonhole argument; blocks of SimHash bits cannot serve, as lines at a similarity of 0.8 differ in about 13 of 64
       bits. Short lines meet in all blocks of two words, others in ten MinHashes of their blocks of three. Those whose
       lengths, bags of words and SimHashes allow the similarity are linked; a spanning forest of links is returned.
    3. The forest's lines are fetched and their edit similarity over words is verified.
    4. A link that fails leaves its two sides apart, though another pair between them may pass. So in clusters
       with a failed link, all likely pairs whose sides are still apart are verified too.
    5. The group's first place keeps its line.
    """
    named = docs.where(F.col(id_col).isNotNull())
    lines = cut(lines_of(named, min_words, id_col, text_col))
    kinds = cut(lines.groupBy("kind").agg(F.count("*").alias("places"), F.min(place("id", "line")).alias("first")).select("kind", "places", *id_and_line("first", "fid", "fline")))
    groups = groups_of_lines(named, kinds, lines.count(), min_words, max_bits, similarity, id_col, text_col)
    grouped = kinds.join(small(groups, 16), kinds["kind"] == groups["node"], "left").withColumn("g", F.coalesce("component", "kind"))
    firsts = grouped.where("component is not null").groupBy(F.col("g").alias("keep_g")).agg(F.min(place("fid", "fline")).alias("keep")).select("keep_g", *id_and_line("keep", "gid", "gline"))
    grouped = grouped.join(firsts, F.col("g") == F.col("keep_g"), "left").select(F.col("kind").alias("__kind"), "places", "fid", "fline", F.coalesce("gid", "fid").alias("kid"), F.coalesce("gline", "fline").alias("kline"))
    grouped = cut(grouped.where("places > 1 OR kid <> fid OR kline <> fline").select("__kind", "kid", "kline"))
    gone = lines.join(small(grouped, 32), F.col("kind") == F.col("__kind")).where("id <> kid OR line <> kline").select(F.col("id").alias(id_col), "text_hash", "line")
    return lines, cut(gone.distinct())


def repeated_lines(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """``lines_and_gone`` with ``(id, line)`` of the lines that go, whatever text of the id they stand in."""
    lines, gone = lines_and_gone(docs, **how)
    return lines, gone.drop("text_hash").distinct()


def fresh_names(docs: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` with as many underscores before them as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, **how) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts; all rows and columns stay, whatever the columns' names.

    A line goes if another of its group comes first, by id and place; lines without words (and with fewer than
    ``min_words``), null and empty texts and rows with a null id stay as they are. A text may end up empty. Rows equal in
    id and text lose the same lines; rows of one id with other texts lose their own, and a line that stands at one
    number in two of them is one place. ``counts`` adds ``n_lines`` and ``n_removed``.
    """
    _, gone = lines_and_gone(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), **how)
    ident, of, lost, text, parts = fresh_names(docs, "gone_id", "gone_text", "gone_lines", "kept_text", "text_parts")
    gone = cut(gone.groupBy(F.col("doc_id").alias(ident), F.col("text_hash").alias(of)).agg(F.sort_array(F.collect_list("line")).alias(lost)))
    n, size = gone.agg(F.count("*"), F.coalesce(F.sum(F.size(lost)), F.lit(0))).first()
    same = (F.col(f"`{id_col}`").cast("long") == F.col(ident)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(of))
    joined = docs.join(F.broadcast(gone) if 40 * n + 4 * size <= BROADCAST_BYTES else gone, same, "left")
    joined = joined.withColumn(parts, F.when(F.col(lost).isNotNull(), F.split(f"`{text_col}`", "\n", -1)))
    left = F.expr(f"array_join(transform(array_except(sequence(0, size({parts}) - 1), {lost}), i -> {parts}[i]), '\\n')")
    out = joined.withColumn(text, F.when(F.col(parts).isNull(), F.col(f"`{text_col}`")).otherwise(left))
    kinds = dict(docs.dtypes)
    cols = [F.col(text).alias(c) if c == text_col else F.char_length(text).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    added = [F.coalesce(F.octet_length(f"`{text_col}`") - F.octet_length(F.replace(F.col(f"`{text_col}`"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).alias("n_removed")]
    return out.select(*cols, *(added if counts else []))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
