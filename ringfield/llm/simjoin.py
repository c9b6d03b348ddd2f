"""N-gram Jaccard join by parity sketches (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Texts, blocks, fresh, gram_hashes, maybe_broadcast, mix, partitions, release, remove_folder, shared_folder, small_batches, spans_of, stored, table_of, word_hashes

#: Words of a shingle; documents link at intersection/union >= 3/4 (the bounds below are derived for it).
WORDS = 5
#: Documents of which one in ORDER_SAMPLE, chosen by hash, is counted to find frequent keys, the count from which a key
#: is frequent, and how many of them are broadcast at most. They only set the order of a document's keys.
ORDER_SAMPLE, FREQUENT, FREQUENT_MOST = 8, 3, 1 << 20
#: Classes of one bucket that are written in one row and compared at once; larger buckets go in several rows.
BUCKET = 256
#: Classes that one task gathers for one key (by the counted sample); keys of more are dealt over several tasks.
HOT_KEY = 1 << 18
#: Classes (or small buckets) that a task remembers so as not to send them twice.
SEEN = 1 << 17
#: Plausible pairs for each class of a meeting up to which it gives all of them.
SPARSE = 4
#: Pairs that a meeting with more gives for each two components, round by round; after these rounds it gives all.
GROWTH = (1, 8, 128)
#: Sizes travel as 16-bit codes, logarithms to this base; sizes within 4/3 have codes at most SIZE_GAP apart.
SIZE_BASE, SIZE_GAP = 1.0005, 577
#: Fewest 64-bit words of the bit sketch that each class keeps; it has at least as many bits as the set has shingles.
SKETCH = 8
#: Slots of the fixed-size bitmap that thins out the texts before the exact join with wanted classes.
BITMAP_BITS = 24
#: Partners of one class that are verified in one task.
STAR = 256
#: Bytes of text that a worker hashes at once.
STEP_BYTES = 1 << 18
#: Links that one task unites before labels travel between tasks.
EDGES = 1 << 17
#: Rows of a narrow table that one task reads, groups and joins without a shuffle.
TASK_ROWS = 1 << 18

_WHITE = table_of("white")


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the word shingles of every text of the column.

    Words are runs without ASCII white space, A-Z folded. A text with fewer words is one shingle, its whole
    sequence; a text without words has none.
    """
    t = Texts(column)
    folded = _WHITE[t.bytes]
    starts, ends = spans_of(folded > 0, t.offsets)
    hashes = word_hashes(folded, starts, ends)
    grams = gram_hashes(hashes, words)
    at = np.searchsorted(starts, t.offsets).tolist()
    out = []
    for a, z in zip(at[:-1], at[1:], strict=True):
        if z - a >= words:
            out.append(np.unique(grams[a : z - words + 1]))
        elif z > a:
            out.append(gram_hashes(hashes[a:z], z - a) ^ np.uint64(z - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def levels_of(n: int) -> list[int]:
    """Size bands: a document of n shingles is in band floor(log2 n), and also meets partners of 3/4 of its size."""
    own, less = n.bit_length() - 1, max(1, -(-3 * n // 4)).bit_length() - 1
    return [own] if own == less else [own, less]


def parts_of(level: int) -> int:
    """Parts of a sketch in a size band, few enough that most hold several hashes of a set.

    A set of the band has 2^level to 8/3 * 2^level hashes and must fill more than a third as many parts; the root leaves
    five standard deviations for that. Sets of fewer than 16 hashes get parts of their own for nearly every one.
    """
    return 1024 if level < 4 else (1 << level) + (4 << level // 2)


def parity_words(s: np.ndarray, level: int) -> np.ndarray:
    """The keys of the non-empty parts of a set's sketch in a size band: those of several hashes first, each in the order of the parts.

    The space of hashes is cut into m parts; each part's word is the XOR of the hashes in it. A token in one set
    alone changes the word of one part, so the number of parts that differ is a lower bound of the symmetric
    difference. The key names band, part, word and whether the part holds one hash or more, so its place in the order
    is the same for all sets that show it. Texts that share one shingle by chance, or a common line, share
    the keys of parts that hold one hash, hardly ever those of several.
    """
    part = ((s >> np.uint64(32)) * np.uint64(parts_of(level))) >> np.uint64(32)
    first = np.flatnonzero(np.diff(part, prepend=part[:1] ^ np.uint64(1)))
    word = np.bitwise_xor.reduceat(mix(s), first)
    single = np.diff(first, append=len(s)) == 1
    keys = mix(word ^ mix(part[first] + np.uint64(level << 56) + (single.astype(np.uint64) << np.uint64(48))))
    return np.concatenate([keys[~single], keys[single]])


def probe_keys(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The keys that a set must show so that every set with Jaccard similarity of 3/4 or more shares one.

    For sizes a <= b <= 4a/3 and similarity >= 3/4 the symmetric difference is at most (a + b)/7, which is at most a/3
    and, from the larger side, b/4. So at most d = floor(n/3) non-empty parts of a set of n differ from a partner's,
    and by the pigeonhole its first d + 1 keys in any order common to all sets (rare before frequent,
    parts of several hashes before those of one, then by part) hold a common one. With fewer keys than that, all of them and the band's empty key go out.
    """
    out = []
    for level in levels_of(len(s)):
        keys = parity_words(s, level)
        need = len(s) // 3 + 1
        if len(keys) < need:
            # Too few non-empty parts for the guarantee: equal empty parts may be the only common ones.
            keys = np.append(keys, mix(np.array([level], np.uint64) + np.uint64(1 << 60)))
        elif len(frequent) and len(keys) > need:
            place = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
            often = frequent[place] == keys
            keys = np.concatenate([keys[~often], keys[often]])[:need]
        else:
            keys = keys[:need]
        out.append(keys)
    return np.concatenate(out) if len(out) > 1 else out[0]


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """A parity sketch: each hash flips one of B bits, B the power of two from the size of the set on.

    The lowest bits of the hash choose the bit, so XOR-ing its halves gives the sketch of half the length.
    """
    size = max(64 * SKETCH, 1 << max(0, len(s) - 1).bit_length())
    bits = np.bincount((mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _class_id(s: np.ndarray, salt: int) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set."""
    a = np.bitwise_xor.reduce(mix(s + np.uint64(salt)))
    b = np.add.reduce(mix(s ^ np.uint64(0x2545F4914F6CDD1D)))
    n = np.uint64(len(s))
    return int(mix(np.array([a + n], np.uint64)).view(np.int64)[0]), int(mix(np.array([b ^ n], np.uint64)).view(np.int64)[0])


def size_code(n: int) -> int:
    return int(math.log(n) / math.log(SIZE_BASE))


def describe(docs: DataFrame, salt: int) -> DataFrame:
    """One narrow row for each document: id, class (fingerprint of its set), check, n, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text", STEP_BYTES):
                rows = []
                for s in shingle_sets(b.column(1)):
                    rows.append((*_class_id(s, salt), len(s), bit_sketch(s)) if len(s) else (0, 0, 0, np.zeros(SKETCH, np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["id", "class", "check", "n", "sketch"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, class long, check long, n long, sketch array<long>")


def frequent_keys(docs: DataFrame, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that many classes show, sorted, and about how many, counted on one document in ORDER_SAMPLE.

    They order the keys of a document, and spread the keys of more than HOT_KEY classes over several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for b in blocks(whole, "text", STEP_BYTES):
                keys = [np.zeros(0, np.uint64)]
                for s in shingle_sets(b.column(1)):
                    if len(s) > 2 and _new(seen, c := _class_id(s, salt)[0]):
                        # Later words than these hardly ever come among the first.
                        keys += [parity_words(s, level)[: len(s) // 2 + 2] for level in levels_of(len(s))]
                k, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(ORDER_SAMPLE)) == 0)
    found = sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(FREQUENT_MOST).toArrow()
    keys, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy() * ORDER_SAMPLE
    order = np.argsort(keys)
    return keys[order], n[order]


def _new(seen: set[int], c: int) -> bool:
    """Whether a class was not seen lately: its keys go out once for most of its copies (a second time does no harm)."""
    if c in seen:
        return False
    if len(seen) >= SEEN:
        seen.clear()
    seen.add(c)
    return True


def buckets(docs: DataFrame, known: tuple[np.ndarray, np.ndarray], salt: int) -> DataFrame:
    """The classes that share a key: rows of ``bucket``, ``large`` and sorted ``classes`` (at most BUCKET).

    Each task sends the keys of a class once, packed by target partition: a few rows of bytes for each target
    instead of a row for each key. A target sorts its keys and writes the buckets of two or more classes, cut
    where the next larger size is out of reach; equal small buckets (many keys of one group of near
    copies) are written once. Larger buckets are ``large`` and come in several rows; so are keys of
    more than HOT_KEY classes, which are dealt over several targets.
    """
    spark = docs.sparkSession
    targets = max(partitions(spark), 1)
    frequent = known[0]
    hot = known[1] > HOT_KEY
    hot, dealt = frequent[hot], -(-known[1][hot] // HOT_KEY)

    def among(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(hot, k), len(hot) - 1)
        return place, hot[place] == k

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, classes, codes, held = [], [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            k, c, z = np.concatenate(keys), np.concatenate(classes), np.concatenate(codes)
            spread = k
            if len(hot):
                place, is_hot = among(k)
                spread = np.where(is_hot, k + mix(c.view(np.uint64)) % dealt[place].astype(np.uint64), k)
            to = (spread % np.uint64(targets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            k, c, z, to = k[order], c[order], z[order], to[order]
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            ends = np.append(cut[1:], len(to))
            parts = [pa.array([x[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()) for x in (k, c, z)]
            yield pa.RecordBatch.from_arrays([pa.array(to[cut]), *parts], ["target", "keys", "classes", "codes"])

        for whole in batches:
            for b in blocks(whole, "text", STEP_BYTES):
                for s in shingle_sets(b.column(1)):
                    # A set of at most two shingles has no partner but its equals.
                    if len(s) > 2 and _new(seen, c := _class_id(s, salt)[0]):
                        own = probe_keys(s, frequent)
                        keys.append(own)
                        classes.append(np.full(len(own), c, np.int64))
                        codes.append(np.full(len(own), size_code(len(s)), np.uint16))
                        held += len(own)
                if held > 1 << 18:
                    yield from packed()
                    keys, classes, codes, held = [], [], [], 0
        if held:
            yield from packed()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.uint64, np.int64, np.uint16)]
        for b in batches:
            for k, own in enumerate(parts):
                own += [np.frombuffer(x, own[0].dtype) for x in b.column(k + 1).to_pylist()]
        k, c, z = (np.concatenate(own) for own in parts)
        parts.clear()
        order = np.lexsort((c, z, k))
        k, c, z = k[order], c[order], z[order].astype(np.int64)
        same = np.diff(k, prepend=k[:1] ^ np.uint64(1)) == 0
        # The rows of a class that several tasks have sent stand together.
        kept = ~(same & (np.diff(c, prepend=c[:1]) == 0) & (np.diff(z, prepend=z[:1]) == 0))
        k, c, z, same = k[kept], c[kept], z[kept], same[kept]
        wide = among(k)[1] if len(hot) else np.zeros(len(k), bool)
        first = np.flatnonzero(~same | ~wide & (np.diff(z, prepend=z[:1]) > SIZE_GAP))
        size = np.diff(np.append(first, len(k)))
        some = (size > 1) | wide[first]
        small: set[bytes] = set()
        out: list[tuple[int, bool, np.ndarray]] = []
        for a, n in zip(first[some].tolist(), size[some].tolist(), strict=True):
            group = np.sort(c[a : a + n])
            if n <= BUCKET and not wide[a]:
                raw = group.tobytes()
                if raw not in small:
                    if len(small) >= SEEN:
                        small.clear()
                    small.add(raw)
                    out.append((0, False, group))
            else:
                name = int(k[a : a + 1].view(np.int64)[0]) if wide[a] else int((k[a : a + 1] + np.uint64(z[a])).view(np.int64)[0])
                out += [(name, True, group[j : j + BUCKET]) for j in range(0, n, BUCKET)]
            if len(out) > 2000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["bucket", "large", "classes"])

    sent = docs.mapInArrow(send, "target int, keys binary, classes binary, codes binary")
    return sent.repartition(targets, "target").mapInArrow(meet, "bucket long, large boolean, classes array<long>")


def sized(table: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """``stored``, with the number of rows (seen while writing). Up to TASK_ROWS rows are read by one task: grouping them needs no shuffle."""
    seen = Observation()
    out = stored(table.observe(seen, F.count(F.lit(1)).alias("n")), folder)
    n = seen.get["n"]
    return (out.coalesce(1) if n <= TASK_ROWS else out), n


def texts_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: str) -> DataFrame:
    """The texts (``class``, ``text``) of the representatives of all classes of the pairs, from one scan of the documents.

    Few ids (counted) are broadcast to the scan; for more, a bitmap of fixed size, built from the ids, thins out the scan and
    a join on the id makes it exact. Texts are smaller than sets of shingles.
    """
    ends, n = sized(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), scratch)
    few = n <= BROADCAST_ROWS
    wanted = classes.select("class", "rep").join(F.broadcast(ends) if few else ends, "class")
    if few:
        return stored(docs.join(F.broadcast(wanted), docs["id"] == wanted["rep"]).select("class", "text"), scratch)
    wanted = stored(wanted, scratch)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    for r in wanted.select(slot("rep").alias("slot")).selectExpr("cast(slot div 64 as int) AS w", "shiftleft(1L, cast(slot % 64 as int)) AS bit").groupBy("w").agg(F.bit_or("bit").alias("bits")).collect():
        bitmap[r["w"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            some = b.filter(pa.array((bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            yield pa.RecordBatch.from_arrays(some.columns[:2], ["id", "text"])

    few = docs.select("id", "text", slot("id").alias("slot")).mapInArrow(thin, f"id {docs.schema['id'].dataType.simpleString()}, text string")
    return stored(few.join(wanted, few["id"] == wanted["rep"]).select("class", "text"), scratch)


def verified(pairs: DataFrame, texts: DataFrame, salt: int, scratch: str) -> DataFrame:
    """The pairs (a, b) that link, decided exactly on the sets of shingles.

    The text of b travels to the tasks of a; a class with many partners is dealt over several of them, STAR partners each.
    """
    spark = pairs.sparkSession
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    dealt, n = sized(pairs.join(stars, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")), scratch)
    near = F.broadcast if n <= BROADCAST_ROWS else lambda table: table
    right = texts.join(near(dealt), dealt["b"] == texts["class"]).select("a", "part", F.lit(1).alias("kind"), "b", "text")
    heads = near(dealt.select("a", "part").distinct())
    left = texts.join(heads, heads["a"] == texts["class"]).select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, own = None, np.zeros(0, np.uint64)
        for whole in batches:
            for b in blocks(whole, "text", STEP_BYTES):
                out = []
                for a, what, c, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), shingle_sets(b.column(4)), strict=True):
                    if not len(s) or _class_id(s, salt)[0] != c:
                        continue  # another row with this id
                    if what == 0:
                        star, own = a, s
                    elif star == a:
                        common = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * common >= 75 * (len(own) + len(s) - common):
                            out.append((a, c))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(2)], ["a", "b"])

    met = left.union(right).repartition(partitions(spark), "a", "part").sortWithinPartitions("a", "part", "kind")
    return sized(met.mapInArrow(compare, "a long, b long"), scratch)[0]


def components(edges: DataFrame, scratch: str) -> DataFrame:
    """The smallest node reachable from every node of the edges (a, b): ``node`` and ``root``.

    Each task unites EDGES edges first; where these are more, labels travel between the groups found. Every round all nodes of a
    label take the least label next to any of them, and then the label that this one took, so long chains shrink by
    jumps; each round's table is written and read back.
    """
    tasks = -(-edges.count() // EDGES)
    near = (edges.coalesce(1) if tasks <= 1 else edges.repartition(tasks)).mapInArrow(_unite, "node long, root long")
    if tasks <= 1:
        return sized(near, scratch)[0]
    both = stored(near.where("node <> root").select(F.explode(F.array(F.struct(F.col("node").alias("a"), F.col("root").alias("b")), F.struct(F.col("root").alias("a"), F.col("node").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), scratch)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), scratch)
    while True:
        least = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(least, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # All nodes with one label take the least that any of them met, and then the one that those took.
        met = step.groupBy("old").agg(F.min("root").alias("met"))
        jump = step.join(met, "old").select("node", "old", "met").join(met.select(F.col("old").alias("met"), F.col("met").alias("root")), "met").select("node", "old", "root")
        after = stored(jump, scratch)
        labels = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return labels


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a task's edges, each with the least node of its component there."""
    ends = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for b in batches:
        for k in range(2):
            ends[k].append(b.column(k).to_numpy())
    names, at = np.unique(np.concatenate([*ends[0], *ends[1]]), return_inverse=True)
    parent = list(range(len(names)))
    for x, y in zip(at[: len(at) // 2].tolist(), at[len(at) // 2 :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        parent[max(x, y)] = min(x, y)
    for x, above in enumerate(parent):
        parent[x] = parent[above]  # names are in order and a parent comes first: its own is a root by now
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[parent] if len(names) else names)], ["node", "root"])


def rooted(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (with a column ``class``) and the component that each is known to be in: at first itself."""
    return members.join(labels.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def united(large: DataFrame) -> DataFrame:
    """Large buckets (``bucket``, ``class``) without their repetition: near copies share many keys, so many buckets hold almost the same classes.

    The home of a class is its largest bucket. A bucket joins the one that most of its classes have as their home, so any
    two classes of one bucket are in one bucket still, and a class of a group of near copies is there once.
    """
    size = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    home = large.join(maybe_broadcast(size), "bucket").groupBy("class").agg(F.max(F.struct("size", "bucket")).alias("top")).select("class", F.col("top.bucket").alias("home"))
    most = large.join(home, "class").groupBy("bucket", "home").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "home")).alias("top")).select("bucket", F.col("top.home").alias("into"))
    return large.join(maybe_broadcast(most), "bucket").select(F.col("into").alias("bucket"), "class").distinct()


def gatherings(large: DataFrame) -> DataFrame:
    """Rows (``row``, ``class``) of about BUCKET classes that bring large groups together: each class goes to its largest bucket only."""
    size = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    best = large.join(maybe_broadcast(size), "bucket").groupBy("class").agg(F.max(F.struct("size", "bucket")).alias("best"))
    part = F.pmod(F.xxhash64("class"), F.ceil(F.col("best.size") / BUCKET))
    return best.select(F.xxhash64("best.bucket", part).alias("row"), "class")


def split(large: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of large buckets in rows of about BUCKET (``row``, ``class``), and which rows meet (``left``, ``right``).

    The classes of a bucket's largest component and the rest are in rows apart; two rows of that component do not meet.
    """
    pieces = large.join(labels.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    shares = pieces.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("size"))
    shares = shares.select("bucket", F.col("top.root").alias("main"), F.ceil(F.col("top.n") / BUCKET).alias("main_rows"), F.ceil((F.col("size") - F.col("top.n")) / BUCKET).alias("rest_rows")).where("rest_rows > 0")
    name = lambda kind, part: F.xxhash64("bucket", F.lit(kind), part)
    part = lambda n: F.pmod(F.xxhash64("class"), F.col(n))
    rows = pieces.join(maybe_broadcast(shares), "bucket").select(F.when(F.col("root") == F.col("main"), name("main", part("main_rows"))).otherwise(name("rest", part("rest_rows"))).alias("row"), "class")
    each = shares.select("bucket", "main_rows", "rest_rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_rows") - 1)).alias("i"))
    other = lambda kind, lo, n: each.select("bucket", "i", F.explode(F.sequence(lo, F.col(n) - 1)).alias("j")).select(name("rest", F.col("i")).alias("left"), name(kind, F.col("j")).alias("right"))
    return rows, other("rest", F.col("i"), "rest_rows").union(other("main", F.lit(0).cast("long"), "main_rows"))


class _Members:
    """The lists of a column of classes with component, size and sketch as flat arrays."""

    def __init__(self, column: pa.ListArray):
        v, words = column.values, column.values.field("sketch")
        self.at, self.cut = column.offsets.to_numpy(), words.offsets.to_numpy()
        self.words = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
        self.columns = [v.field(f).to_numpy(zero_copy_only=False) for f in ("class", "root", "n")]

    def size(self, k: int) -> int:
        return int(self.at[k + 1] - self.at[k])

    def of(self, k: int) -> dict[int, tuple[np.ndarray, ...]]:
        """Classes, roots, sizes and sketches of list k, by the length of the sketch."""
        lo, hi = int(self.at[k]), int(self.at[k + 1])
        lens, out = np.diff(self.cut[lo : hi + 1]), {}
        for size in set(lens.tolist()):
            at = lo + np.flatnonzero(lens == size)
            out[size] = (*[x[at] for x in self.columns], self.words[self.cut[at][:, None] + np.arange(size)])
        return out


def _plausible(xs: dict, ys: dict | None) -> list[np.ndarray]:
    """Pairs of classes of two lists (of one: ys is None) in different components that sizes and sketches allow.

    Arrays: both classes (smaller first), both roots, and the Hamming distance of the sketches over both sizes (above 1/7 the
    similarity is below 3/4).
    """
    found: list[list[np.ndarray]] = []
    for s, (c, r, n, k) in xs.items():
        for t in (s, 2 * s) if ys is None else (s // 2, s, 2 * s):
            # Sizes within 4/3 have sketches of equal length or one of twice the other's.
            if t not in (xs if ys is None else ys):
                continue
            c2, r2, n2, k2 = (xs if ys is None else ys)[t]
            fits = (r[:, None] != r2) & (4 * np.minimum(n[:, None], n2) >= 3 * np.maximum(n[:, None], n2))
            i, j = np.nonzero(np.triu(fits) if ys is None and t == s else fits)
            half = lambda w, size: w if w.shape[1] == size else w[:, :size] ^ w[:, size:]
            u, w = half(k, min(s, t)), half(k2, min(s, t))
            step = max(1, (1 << 19) // min(s, t))
            for at in range(0, len(i), step):
                p, q = i[at : at + step], j[at : at + step]
                both = n[p] + n2[q]
                far = np.bitwise_count(u[p] ^ w[q]).sum(axis=1, dtype=np.int64)
                p, q, far = p[fine := 7 * far <= both], q[fine], far[fine] / both[fine]
                found.append([np.minimum(c[p], c2[q]), np.maximum(c[p], c2[q]), r[p], r2[q], far])
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the edges (a, b), taken in order, that join two trees; nodes are small numbers."""
    parent, kept, trees = list(range(int(max(a.max(), b.max())) + 1)), [], len(np.unique(np.concatenate([a, b])))
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            kept.append(k)
            if len(kept) == trees - 1:
                break
    return kept


def candidates(members: DataFrame, meetings: DataFrame | None, labels: DataFrame, classes: DataFrame, refused: DataFrame | None, most: int | None, scratch: str) -> DataFrame:
    """The pairs (``m`` for the meeting, ``a``, ``b``, ``far``) to verify next: plausible ones across two components.

    Every row of ``members`` (``row``, ``class``) meets itself, or those rows meet that ``meetings`` (``left``, ``right``) names.
    A meeting compares all its classes in numpy. It gives all its pairs if these are no more than SPARSE for each
    of its classes. Else (``more``), with ``most`` = 1, it gives the closest pairs that together join all components that
    can be joined there, one pair less than these are; or at most so many for each two components (None: all). Pairs
    found wrong before (``refused``) are not given again.
    """
    full = maybe_broadcast(rooted(members, labels)).join(classes.select("class", "n", "sketch"), "class")
    told = full.groupBy("row").agg(F.collect_list(F.struct("class", "root", "n", "sketch")).alias("list"))
    if meetings is None:
        met = told.select(F.col("row").alias("m"), F.col("list").alias("x"), F.expr("if(true, null, list)").alias("y"))
    else:
        m = F.xxhash64("left", "right").alias("m")
        sides = meetings.select(m, F.col("left").alias("row"), F.lit(0).alias("side")).union(meetings.where("left <> right").select(m, F.col("right").alias("row"), F.lit(1).alias("side")))
        side = lambda k, x: F.first(F.when(F.col("side") == k, F.col("list")), ignorenulls=True).alias(x)
        met = told.join(maybe_broadcast(sides), "row").groupBy("m").agg(side(0, "x"), side(1, "y"))
    if refused is None:
        met = met.select("m", "x", "y", F.expr("cast(null AS array<struct<a: bigint, b: bigint>>)").alias("no"))
    else:
        met = met.join(maybe_broadcast(refused.groupBy("m").agg(F.collect_list(F.struct("a", "b")).alias("no"))), "m", "left").select("m", "x", "y", "no")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[tuple] = []
            left, right, two = _Members(batch.column(1)), _Members(batch.column(2)), batch.column(2).is_valid().to_pylist()
            for k, (m, no) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b, ra, rb, far = _plausible(left.of(k), right.of(k) if two[k] else None)
                if no and len(a):
                    wrong = {(p["a"], p["b"]) for p in no}
                    a, b, ra, rb, far = (v[[p not in wrong for p in zip(a.tolist(), b.tolist(), strict=True)]] for v in (a, b, ra, rb, far))
                if not len(a):
                    continue
                names, at = np.unique(np.concatenate([ra, rb]), return_inverse=True)
                lo, hi = np.minimum(at[: len(a)], at[len(a) :]), np.maximum(at[: len(a)], at[len(a) :])
                code = lo * len(names) + hi
                order = np.lexsort((b, a, far, code))
                more = most is not None and len(a) > SPARSE * (left.size(k) + right.size(k))
                if more:
                    first = np.flatnonzero(np.diff(code[order], prepend=-1))
                    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                    order = order[place < most]
                if more and most == 1:
                    order = order[np.lexsort((b[order], a[order], far[order]))]
                    order = order[_forest(lo[order], hi[order])]
                if not more:
                    # Nobody asks which meeting gave these, and near copies meet in many buckets: a task gives a pair once.
                    order = order[[p not in given and not given.add(p) for p in zip(a[order].tolist(), b[order].tolist(), strict=True)]]
                    if len(given) > SEEN:
                        given.clear()
                out.append((np.full(len(order), m), a[order], b[order], far[order], np.full(len(order), more)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["m", "a", "b", "far", "more"])

    return sized(met.mapInArrow(compare, "m long, a long, b long, far double, more boolean"), scratch)[0]


class _Links:
    """The verified links so far and the components that they make."""

    def __init__(self, classes: DataFrame, docs: DataFrame, salt: int, scratch: str):
        self.classes, self.docs, self.salt, self.scratch = classes, docs, salt, scratch
        none = docs.sparkSession.range(0)
        self.labels = none.select(F.col("id").alias("node"), F.col("id").alias("root"))

    def across(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that lie across two components."""
        root = lambda x: self.labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        joined = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        return joined.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)

    def add(self, pairs: DataFrame, texts: DataFrame) -> None:
        """Verify the pairs (stored) and join the components of those that link."""
        new = verified(pairs, texts, self.salt, self.scratch)
        release(self.docs.sparkSession)
        if not new.isEmpty():
            known = self.labels.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            self.labels = maybe_broadcast(components(known.union(new), self.scratch))

    def join_up(self, members: DataFrame, meetings: DataFrame | None = None) -> None:
        """Verify pairs until no meeting holds two classes that may link and are in two components."""
        refused = None
        for most in (*GROWTH, None):
            pairs = candidates(members, meetings, self.labels, self.classes, refused, most, self.scratch)
            each = pairs.select("a", "b").distinct()
            if refused is not None:
                each = each.join(refused.select("a", "b").distinct(), ["a", "b"], "left_anti")
            each, n = sized(each, self.scratch)
            if not n:
                # All pairs of the round were refused before, in other meetings: those that hold pairs back have more to tell.
                if pairs.where("more").isEmpty():
                    break
                continue
            texts = texts_of(each, self.classes, self.docs, self.scratch)
            self.add(each, texts)
            # Only a meeting that held pairs back and gave one that was found wrong has more to tell.
            wrong, n = sized(self.across(pairs.where("more").select("m", "a", "b")), self.scratch)
            if not n:
                break
            alive = maybe_broadcast(wrong.select("m").distinct())
            refused = wrong if refused is None else sized(refused.join(alive, "m", "left_semi").union(wrong), self.scratch)[0]
            if meetings is None:
                # Written, since each round reads them twice and would else join them with all rounds before.
                members = sized(members.join(alive.withColumnRenamed("m", "row"), "row", "left_semi"), self.scratch)[0]
            else:
                meetings = sized(meetings.join(alive, F.xxhash64("left", "right") == alive["m"], "left_semi"), self.scratch)[0]


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connected components of the documents under Jaccard similarity of 3/4 or more of their 5-word shingle sets.

    Method. Documents with equal sets are one class. Per size band a set's hashes are XOR-ed into the words of
    a parity sketch; sets that are similar enough agree, by the pigeonhole, on one of the first few non-empty words, and
    a shuffle of these words brings all candidates into common buckets. Buckets with the same classes count once. The
    classes of a bucket compare sizes and sketches and give the closest pairs that would join their components; these are
    verified on the sets themselves. Buckets with pairs that proved wrong give more pairs, until no bucket
    holds a plausible pair across two components. So no link that decides a component is lost, and what
    a bucket sends on is in proportion to its size.

    Returns the id, ``n_shingles``, ``class_id`` (least id with an equal set) and ``component_id`` (least id reachable, itself
    included). Null and empty texts have no shingle and are alone, each with its own id. Rows of equal id
    each get their row. Rows without an id count like others: a class or component with no id at all has a null
    ``class_id`` or ``component_id``. An empty table gives no rows. Other columns of the table are not looked at. The
    session's ``spark.sql.execution.arrow.maxBytesPerBatch`` is lowered to 8 MB where it has its default.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not docs.where("id IS NULL").isEmpty():
        return _by_row(docs).withColumnRenamed("id", id_col)
    spark = docs.sparkSession
    kept, scratch = shared_folder(spark, "similar"), shared_folder(spark, "similar-scratch")
    salt = 0
    while True:
        base = stored(describe(docs, salt), kept)
        full = base.where("n > 0")
        classes = stored(full.groupBy("class").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), (F.min("check") != F.max("check")).alias("torn")), kept)
        if classes.where("torn").isEmpty():
            break
        salt += 1  # two different sets with one fingerprint: take others
    found = stored(buckets(docs, frequent_keys(docs, salt), salt), scratch)
    release(spark)
    state = _Links(classes, docs, salt, scratch)
    large = found.where("large")
    if not large.isEmpty():
        large = sized(united(sized(large.select("bucket", F.explode("classes").alias("class")), scratch)[0]), scratch)[0]
        state.join_up(sized(gatherings(large), scratch)[0])
        state.join_up(*(sized(x, scratch)[0] for x in split(large, state.labels)))
    # Many keys of a shared passage have the same classes: such buckets count once.
    small, n = sized(found.where("NOT large").select("classes").distinct().select(F.xxhash64("classes").alias("row"), F.explode("classes").alias("class")), scratch)
    if not state.labels.isEmpty():
        # Buckets within one component need no further look.
        small, n = sized(small.join(rooted(small, state.labels).groupBy("row").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("row"), "row", "left_semi"), scratch)
    if n:
        state.join_up(small)
    known = sized(state.labels.select(F.col("node").alias("class"), "root").join(classes.select("class", "rep"), "class"), kept)[0]
    remove_folder(spark, scratch)
    ids = known.groupBy("root").agg(F.min("rep").alias("component"))
    linked = maybe_broadcast(known.join(ids, "root").select("class", F.struct("component").alias("linked")))
    # A component without any id has none, so a link counts even where its least id is null.
    told = classes.join(linked, "class", "left").select("class", F.col("rep").alias("class_id"), F.when(F.col("linked").isNull(), F.col("rep")).otherwise(F.col("linked.component")).alias("component_id"))
    return (
        full.join(told, "class").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id")
        .unionByName(base.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id")))
    )


def _by_row(docs: DataFrame) -> DataFrame:
    """``similar_documents`` by keys of the rows, written once so that they stay the same, for tables with null ids."""
    rows = stored(docs.withColumn("key", F.monotonically_increasing_id()), shared_folder(docs.sparkSession, "keyed"))
    told = similar_documents(rows, "key").join(rows.select("key", "id"), "key")
    least = lambda group, name: told.groupBy(group).agg(F.min("id").alias(name))
    return told.join(least("class_id", "class"), "class_id").join(least("component_id", "component"), "component_id").select("id", "n_shingles", F.col("class").alias("class_id"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have a similar one of smaller id: one of each component stays.

    Where ids are repeated or null, rows get keys of their own: of the rows of a component with the least id, or of those
    without an id if all are, one stays, by a hash of its text. Rows without shingles all stay.
    """
    if not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty():
        return _keep_one_row(docs, id_col, text_col)
    gone = stored(similar_documents(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), shared_folder(docs.sparkSession, "gone"))
    return docs.join(maybe_broadcast(gone), id_col, "left_anti").select(*docs.columns)


def _keep_one_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``keep_one`` by keys of the rows, which are written once so that they stay the same."""
    key, folder = fresh(docs, "key"), shared_folder(docs.sparkSession, "gone")
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), folder)
    told = similar_documents(rows, key, text_col).select(key, F.col("component_id").alias("component"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash", key)
    names = rows.select(key, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    stay = told.join(names, key).groupBy("component").agg(F.min(order)[key].alias(key))
    gone = stored(told.select(key).join(stay.select(key), key, "left_anti"), folder)
    return rows.join(maybe_broadcast(gone), key, "left_anti").select(*docs.columns)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS n2 FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 75 * (n2 - c)),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT l.b, r.r FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id
FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
