"""N-gram Jaccard join: size-banded tiles of bitmap signatures, then exact intersection of sorted shingle arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldframe.llm.components import components
from foldframe.llm.work import Work, among, blank_words, slices

#: Shingles counted together while common ones are looked for, and the count from which one is reported.
COUNTED_TOGETHER, REPORTED_FROM = 1 << 22, 2
#: Places in the order of common shingles, which is sent to every task (12 bytes a place).
COMMON = 1 << 20
#: Parts of the shingles that are dealt out one after another, so that a part's shuffles are gone before the next one's are written.
PARTS = 3
#: Rows of a tile's block; a tile of more rows is compared block against block in separate tasks.
BLOCK = 1024
#: Bits for each shingle of a cell's largest set, and bits of all bitmaps of a cell at most; fewer bits let more pairs through to exact work.
BITS, MAP_BITS = 16, 1 << 29
#: What names a cell: the rows of one or two blocks of a tile that are compared in one task.
CELL = ["lo", "band", "kind", "x", "y"]
#: Keys over which the rows of a tile are dealt while they learn its size.
SALTS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (multiply and fold)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hashes(dict):
    """Hashes of words, computed where one is asked for the first time."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted 64-bit shingle hashes of texts; words hash once each while they are remembered."""

    def __init__(self, words: int):
        self.words, self.known = words, Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        ws = blank_words(text)
        if not ws:
            return np.empty(0, np.uint64)
        if len(self.known) > 500_000:
            self.known.clear()
        x = np.fromiter(map(self.known.__getitem__, ws), np.uint64, len(ws))
        width = min(self.words, len(x))
        n = len(x) - width + 1
        h = np.full(n, np.uint64(width))
        for k in range(width):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n])
        return np.unique(h)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Which low bits of the shingles occur: at least twice as many bits as shingles, a power of two from 64 up."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap narrowed to ``words`` 64-bit words: the lower bits of the same shingles."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def enough(n_a: np.ndarray, n_b: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """den * intersection >= num * union."""
    return (num + den) * common >= num * (n_a + n_b)


def common_shingles(docs: DataFrame, words: int, work: Work) -> DataFrame:
    """The most common shingles (at most COMMON rows: shingle, n), over whole texts of all documents.

    Each task counts stretches of shingles and reports those that occur often in a stretch; the reports are added up. The list
    only orders shingles (common ones last); any order gives the same links, a good one gives small tiles. The counts are written
    ("counted"), and a histogram of them tells from which count on shingles fit; of those at the last count, a range of hashes does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held, size = Shingler(words), [], 0

        def report() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= REPORTED_FROM
            return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["shingle", "n"])

        for part in slices(batches):
            for text in part.column("text").to_pylist():
                held.append(cut(text))
                size += len(held[-1])
                if size >= COUNTED_TOGETHER:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    found = work.keep(docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "counted")
    level = F.least("n", F.lit(1 << 16))
    room = COMMON
    for count, ties in sorted(map(tuple, found.groupBy(level.alias("count")).agg(F.count(F.lit(1))).collect()), reverse=True):
        if ties > room:
            part = max(0, room - 4 * math.isqrt(room))  # hashes spread evenly, so four deviations below the room stay within it
            return found.where((level > count) | ((level == count) & (F.col("shingle") < F.lit(part * 2**64 // ties - 2**63))))
        room -= ties
    return found


def signatures(docs: DataFrame, words: int, num: int, den: int, work: Work) -> DataFrame:
    """docs(id, text, code) to (id, code, n, same, first, bits): set size, 128-bit hash of the set, the rarest shingles, the bitmap.

    Of n shingles the n - ceil(n * num / den) + 1 that come first in the common order are kept in ``first``: two sets that link share
    one of them. A set too small to link with a larger one links only with equal sets, and its ``first`` is empty.
    """
    common = common_shingles(docs, words, work).toArrow()
    work.drop("counted")
    shingles, counts = (common.column(c).to_numpy() for c in ("shingle", "n"))
    by_value = np.argsort(shingles.view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast((shingles.view(np.uint64)[by_value], np.minimum(counts[by_value], 2**31 - 1).astype(np.int32)))
    del common, shingles, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(words)
        shingles, counts = sent.value
        for part in slices(batches):
            out: list[list] = [[], [], [], []]
            for text in part.column("text").to_pylist():
                s = cut(text)
                n = len(s)
                take = n - -(-n * num // den) + 1
                if den * n >= num * (n + 1):
                    weight = np.zeros(n, np.int64)
                    if len(shingles):
                        at = np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)
                        weight = np.where(shingles[at] == s, counts[at], 0)
                    first = s[np.argsort(weight, kind="stable")[:take]].view(np.int64)
                else:
                    first = np.empty(0, np.int64)
                for col, value in zip(out, (n, xxhash.xxh3_128_digest(s.tobytes()), first, bitmap(s).tobytes() if len(first) else b""), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("code"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())], ["id", "code", "n", "same", "first", "bits"])

    return docs.mapInArrow(run, "id long, code long, n long, same binary, first array<long>, bits binary")


def bounded_pairs(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes whose bitmaps leave room for a link."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("n_a") * den >= F.col("n_b") * num).where(F.col("n_b") * den >= F.col("n_a") * num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keep = []
            for n_a, n_b, x, y in zip(*[part.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")], strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(u), len(v))
                u, v = fold(u, w), fold(v, w)
                most = min(n_a - int(np.bitwise_count(u & ~v).sum()), n_b - int(np.bitwise_count(v & ~u).sum()))
                keep.append(bool(enough(n_a, n_b, most, num, den)))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, num: int, den: int, work: Work, tag: str) -> DataFrame:
    """Pairs (a, b) of nodes whose shingle sets link, by exact intersection of the sorted arrays.

    A node's text is that of the row with its id and its text's hash. Hardly any but the texts that occur in a pair are shuffled. A node in very many pairs (the first of a group of copies) is a hot join key
    that Spark may split; its set is computed once in each run of equal keys.
    """
    pairs = work.keep(pairs, f"{tag}-pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "id", "code"), "node")
    met = work.keep(met, f"{tag}-met")
    texts = work.keep(among(docs, met, "id", "code").join(met, ["id", "code"]).select("node", "text"), f"{tag}-texts")
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, last, x = Shingler(words), None, None
        for part in slices(batches):
            keep = []
            for a, text_a, text_b in zip(part.column("a").to_pylist(), part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True):
                if (a, text_a) != last:
                    last, x = (a, text_a), cut(text_a)
                y = cut(text_b)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                keep.append(bool(enough(len(x), len(y), int((large[at] == small).sum()), num, den)))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = work.keep(rows.mapInArrow(run, "a long, b long"), f"{tag}-links")
    work.drop(f"{tag}-pairs", f"{tag}-met", f"{tag}-texts")
    return links


def cell_links(sets: list[np.ndarray], root: np.ndarray, left: np.ndarray, right: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join components, of rows ``left`` against ``right`` (None: among themselves): at most one less than there are rows.

    Rows of one component are not compared; bitmaps bound the overlap of the others, and what they let pass is intersected exactly. ``root``
    holds the component of each row and follows the links found.
    """
    n = np.array([len(s) for s in sets])
    bits = max(64, 1 << (BITS * int(n.max()) - 1).bit_length())
    while bits > 64 and bits * len(sets) > MAP_BITS:
        bits //= 2
    maps = np.zeros((len(sets), bits // 8), np.uint8)
    for k, s in enumerate(sets):
        flags = np.zeros(bits, np.uint8)
        flags[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
        maps[k] = np.packbits(flags, bitorder="little")
    maps, out = maps.view(np.uint64), []
    for at, i in enumerate(left.tolist()):
        j = left[at + 1 :] if right is None else right
        j = j[(root[j] != root[i]) & (n[j] * den >= n[i] * num) & (n[i] * den >= n[j] * num)]
        if not len(j):
            continue
        u, v = maps[i], maps[j]
        most = np.minimum(n[i] - np.bitwise_count(u & ~v).sum(1, dtype=np.int64), n[j] - np.bitwise_count(v & ~u).sum(1, dtype=np.int64))
        for k in j[enough(n[i], n[j], most, num, den)].tolist():
            if root[k] == root[i]:
                continue
            small, large = (sets[i], sets[k]) if n[i] <= n[k] else (sets[k], sets[i])
            place = np.minimum(np.searchsorted(large, small), len(large) - 1)
            if enough(n[i], n[k], int((large[place] == small).sum()), num, den):
                root[root == root[k]] = root[i]
                out.append((i, k))
    return out


def open_rows(n: np.ndarray, maps: list[np.ndarray], comp: np.ndarray, left: np.ndarray, right: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Which rows of a cell have a partner of another component whose bitmap leaves room for a link (``left``, ``right`` as for ``cell_links``)."""
    words = min(map(len, maps))
    maps = np.stack([fold(m, words) for m in maps])
    found = np.zeros(len(n), bool)
    for at, i in enumerate(left.tolist()):
        j = left[at + 1 :] if right is None else right
        if found[i]:
            j = j[~found[j]]
        j = j[(comp[j] != comp[i]) & (n[j] * den >= n[i] * num) & (n[i] * den >= n[j] * num)]
        if not len(j):
            continue
        u, v = maps[i], maps[j]
        most = np.minimum(n[i] - np.bitwise_count(u & ~v).sum(1, dtype=np.int64), n[j] - np.bitwise_count(v & ~u).sum(1, dtype=np.int64))
        j = j[enough(n[i], n[j], most, num, den)]
        found[j] = True
        found[i] |= len(j) > 0
    return found


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray | None]]:
    """The rows of each cell in sorted batches, with the rows to be held against each other; cells without two components are left out."""

    def cell(t: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray | None]]:
        side, comp = (t.column(c).to_numpy() for c in ("side", "component"))
        within = t.column("kind")[0].as_py() == 0 and t.column("x")[0].as_py() == t.column("y")[0].as_py()
        left, right = (np.arange(t.num_rows), None) if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if comp.min() < comp.max() and len(left) and (right is None or len(right)):
            yield t, left, right

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        t = pa.Table.from_batches([*rest, batch])
        change = np.zeros(t.num_rows, bool)
        for c in CELL:
            col = t.column(c).to_numpy()
            change[1:] |= col[1:] != col[:-1]
        starts = np.concatenate(([0], np.flatnonzero(change)))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a > 1:
                yield from cell(t.slice(a, b - a))
        rest = t.slice(starts[-1]).to_batches()
    if rest:
        t = pa.Table.from_batches(rest)
        if t.num_rows > 1:
            yield from cell(t)


def tile_links(docs: DataFrame, tagged: DataFrame, nodes: DataFrame, words: int, num: int, den: int, work: Work) -> DataFrame:
    """tagged(shingle, node, component, n) to links (a, b) between different components, enough to join all that belong together.

    A tile holds the sets with one shingle and a size of one band; sets of the band below come as guests, so sets whose sizes allow
    a link meet in one tile. Tiles of a band with the same smallest component are laid together: sets that share many shingles then
    meet once, not once a shingle. A tile beyond BLOCK rows is dealt out as pairs of blocks, each compared in a task of its own. A cell
    is compared by its rows' bitmaps first, and only rows that have a partner there get their texts and meet again; then it intersects
    exactly and returns fewer links than it has rows.
    """
    step = math.log(den / num) * 1.0001  # sizes that allow a link are less than one band apart
    band = F.floor(F.log("n") / F.lit(step))
    placed = tagged.withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", band + F.col("guest"))
    tiles = placed.groupBy("shingle", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("guest").alias("g"))
    tiles = tiles.where("lo < hi and g = 0").select("shingle", "band", "lo")
    met = placed.join(tiles, ["shingle", "band"]).select("lo", "band", "guest", "node", "component").distinct()
    met = work.keep(met.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))), "met")
    # Tiles beyond one block are at most one in BLOCK rows; their sizes are laid out once for each salt, so no tile's rows come together here.
    large = met.groupBy("lo", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1")
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = met.join(large, ["lo", "band", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).join(nodes.select("node", "n", "bits"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    cell = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.cast("int").alias("side"))
    own = F.flatten(F.transform(others, lambda j: F.array(cell(0, F.least("block", j), F.greatest("block", j), F.col("block") > j), cell(1, F.col("block"), j, F.lit(0)))))
    places = F.when(F.col("guest") == 0, own).otherwise(F.transform(others, lambda j: cell(1, j, F.col("block"), F.lit(1))))
    dealt = rows.withColumn("block", block).withColumn("cell", F.explode(places)).select("lo", "band", "cell.*", "node", "component", "n", "bits")
    ordered = lambda df: df.repartition(*CELL).sortWithinPartitions(*CELL, "node")
    kept = [*CELL, "side", "node", "component"]

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, left, right in cells(batches):
            maps = [np.frombuffer(x, np.uint64) for x in t.column("bits").to_pylist()]
            found = open_rows(t.column("n").to_numpy(), maps, t.column("component").to_numpy(), left, right, num, den)
            if found.any():
                yield from t.select(kept).filter(pa.array(found)).to_batches()

    near = dealt.select(*kept, "n", "bits")
    near = work.keep(ordered(near).mapInArrow(bounded, near.select(*kept).schema), "open")
    work.drop("met")
    held = work.keep(nodes.select("node", "id", "code").join(near.select("node").distinct(), "node"), "tile-nodes")
    texts = work.keep(among(docs, held, "id", "code").join(held, ["id", "code"]).groupBy("node").agg(F.first("text").alias("text")), "tile-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(words)
        for t, left, right in cells(batches):
            ids, comp = (t.column(c).to_numpy() for c in ("node", "component"))
            found = cell_links([cut(x) for x in t.column("text").to_pylist()], comp.copy(), left, right, num, den)
            if found:
                a, b = ids[np.array(found).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    links = work.keep(ordered(near.join(texts, "node").select(*kept, "text")).mapInArrow(run, "a long, b long"), "tile-links")
    work.drop("open", "tile-nodes", "tile-texts")
    return links


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Words are cut at ASCII white space with A-Z lower-cased; a set holds the distinct shingles of ``words`` words, or the whole
    sequence where there are fewer. Two sets link when den * intersection >= num * union. Empty and null texts have no shingles and
    link with nothing.

    Equal sets become one node, known by a number of its own, as one id may have several sets. Nodes that share one of their rarest shingles form a tile. First every node is held against the
    smallest, then the largest node of each of its tiles, which finds groups of near copies with as many pairs as rows. After that
    only tiles with several components are compared, in size bands, bitmap against bitmap, pairs of different components only; what the bound
    lets pass is intersected exactly in the same cell, which returns fewer links than it has rows. So no link between different components is lost, and no group is expanded into all its pairs.

    Ids are integers; rows that share an id are one document with several texts, each with its own set and links, in one component. A row with a null id has the component of the
    rows with an equal set, or null.
    """
    work = Work(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("code"))
    signed = work.keep(signatures(rows, words, num, den, work), "signed")
    named = signed.where("n > 0 and id is not null")
    whole = named.groupBy("same").agg(F.min_by(F.struct("id", "code", "n", "first", "bits"), F.struct("id", "code")).alias("v"))
    nodes = work.keep(whole.select("same", "v.*", F.monotonically_increasing_id().alias("node")), "nodes-0")
    signed = work.keep(signed.select("id", "n", "same"), "sets")
    named = signed.where("n > 0 and id is not null")
    work.drop("signed")
    postings, parts = nodes.where(F.size("first") > 0).select("node", "n", F.explode("first").alias("shingle")), []
    for k in range(PARTS):
        part = postings.where(F.pmod("shingle", F.lit(PARTS)) == k)
        shared = part.groupBy("shingle").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("shingle")
        parts.append(work.keep(part.join(shared, "shingle").withColumn("component", F.col("node")), f"tiles-0-{k}"))
        work.drop()
    tagged = reduce(DataFrame.unionByName, parts)
    nodes = work.keep(nodes.drop("first"), "nodes")
    work.drop("nodes-0")

    # Sets of one id belong together.
    several = named.groupBy("id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo < hi").select("id")
    held = named.select("id", "same").join(several, "id").distinct().join(nodes.select("same", "node"), "same").select("id", "node")
    links = [work.keep(held.join(held.groupBy("id").agg(F.min("node").alias("a")), "id").where("node <> a").select("a", F.col("node").alias("b")), "one-id")]

    # Every set is held against one of each of its tiles, first the smallest, then the largest: as many pairs as rows.
    for k, pick in enumerate((F.min_by, F.max_by), 1):
        lead = tagged.groupBy("shingle").agg(pick(F.struct("node", "component"), "node").alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        star = tagged.join(lead.select("shingle", "lead"), "shingle").where("component <> lead.component").select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
        links.append(verified(rows, nodes, bounded_pairs(star, nodes, num, den), words, num, den, work, f"star-{k}"))
        group = work.keep(components(reduce(DataFrame.unionByName, links), work, f"groups-{k}"), f"group-{k}")
        told = tagged.drop("component").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
        tagged = work.keep(told, f"tiles-{k}")
        work.drop(*([f"tiles-0-{part}" for part in range(PARTS)] if k == 1 else [f"tiles-{k - 1}"]))

    across = tile_links(rows, tagged, nodes, words, num, den, work)
    of = lambda x: group.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    steps = across.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    merged = work.keep(components(steps, work, "merged"), "final")
    first = nodes.select("same", "id", "node").join(group, "node", "left").select("same", "id", F.coalesce("component", "node").alias("node"))
    ends = work.keep(first.join(merged, "node", "left").select("same", "id", F.coalesce("component", "node").alias("node")), "ends")
    least = ends.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").select("node", "least")
    labels = ends.join(least, "node", "left").select("same", F.coalesce("least", "id").alias("component_id"))
    out = signed.select("id", "n", F.when(F.col("n") > 0, F.col("same")).alias("same"))
    out = out.join(labels, "same", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The input's rows and columns with one document of each component: that with the smallest id. Null ids stay."""
    found = shingle_components(docs, id_col, text_col, words, num, den)
    drop = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    drop = Work(docs.sparkSession, "near").keep(drop, "gone")
    rows = docs.withColumn("__gone", F.col(id_col).cast("long"))
    # Only the few rows that share a bit with one that goes are dealt out.
    stay = among(rows, drop, "__gone").join(drop, "__gone", "left_anti")
    return among(rows, drop, "__gone", out=True).unionByName(stay).drop("__gone")
