"""Benchmark decontamination with suffix arrays over shards of the training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldframe.llm.work import slices

WINDOW = 13
#: Words of a shard: a suffix array of this length is built at a time; a longer text makes a longer shard of its own.
SHARD_WORDS = 1 << 19
#: Characters of benchmark text that a shard is held against at a time; a larger benchmark takes more passes over each shard.
BLOCK_CHARS = 8 << 20
#: Bytes that stand between words: all of ASCII but digits and letters. Bytes of other characters belong to words.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.IntegerType()), T.StructField("longest_at", T.IntegerType()), T.StructField("longest_item", T.StringType()),
])
ARROW = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string())


def item_words(text: str | None) -> list[bytes]:
    """Words of digits, letters and characters beyond ASCII, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Start positions ordered by their first ``depth`` codes (beyond the end counts as smallest), by prefix doubling.

    Only positions that still tie are sorted again, so text without repeats costs two or three sorts whatever the depth.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    first = np.empty(n, np.int64)  # rank: the place of the first position that ties
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = codes[order[1:]] != codes[order[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    first[order] = start
    reach = 1
    while reach < depth:
        size_one = new & np.append(new[1:], True)
        places = np.flatnonzero(~size_one)
        if not len(places):
            break
        at = order[places]
        nxt = at + reach
        second = np.where(nxt < n, first[np.minimum(nxt, n - 1)] + 1, 0)
        head = first[at]
        again = np.argsort(head * (n + 1) + second, kind="stable")
        order[places] = at[again]
        head, second = head[again], second[again]
        split = np.ones(len(places), bool)
        split[1:] = (head[1:] != head[:-1]) | (second[1:] != second[:-1])
        new[places] = split
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        first[order] = start
        reach *= 2
    return order


class Benchmark:
    """One block of test items as codes: every suffix of every item, in one array with the items' ends."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        numbers: dict[str, int] = {}
        self.vocabulary: dict[bytes, int] = {}
        codes, left, item, need = [], [], [], []
        for name, text in items:
            ws = item_words(text)
            if not ws:
                continue
            codes += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]
            n, w = len(ws), min(window, len(ws))
            left += range(n, 0, -1)
            item += [numbers.setdefault(name, len(numbers))] * n
            need += [w] * (n - w + 1) + [0] * (w - 1)  # the window's length where one begins
        self.names = [*numbers]
        self.codes = np.array(codes, np.int64)
        self.left, self.item, self.need = (np.array(x, np.int64) for x in (left, item, need))
        self.depth = int(self.left.max()) if len(left) else 1

    def search(self, codes: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Narrow the range of every item suffix in the suffix array word by word, by binary search over all at once.

        Yields (depth, suffixes, low, high) for the suffixes whose first ``depth`` words occur in the shard.
        """
        n = len(order)
        at = np.arange(len(self.codes))
        low, high = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64)
        padded = np.append(codes, -1)
        for depth in range(self.depth):
            live = self.left[at] > depth
            at, low, high = at[live], low[live], high[live]
            want = self.codes[at + depth]
            bounds = []
            for strict in (False, True):
                a, b = low.copy(), high.copy()
                while (busy := a < b).any():
                    mid = (a + b) // 2
                    have = padded[np.minimum(order[np.minimum(mid, n - 1)] + depth, len(codes))]
                    right = busy & ((have <= want) if strict else (have < want))
                    a = np.where(right, mid + 1, a)
                    b = np.where(busy & ~right, mid, b)
                bounds.append(a)
            low, high = bounds
            live = low < high
            at, low, high = at[live], low[live], high[live]
            if not len(at):
                return
            yield depth + 1, at, low, high


def shard_hits(texts: list[str | None], bench: Benchmark) -> list[tuple]:
    """For each text: word count, merged hit spans in words, items, longest match (words, place, item)."""
    get = bench.vocabulary.get
    lengths, codes = [], [0]
    for text in texts:
        ws = item_words(text)
        lengths.append(len(ws))
        codes += [get(w, 0) for w in ws]  # 0: a word of no item
        codes.append(0)  # so nothing matches across texts
    codes = np.array(codes, np.int64)
    begin = 1 + np.cumsum([0, *[k + 1 for k in lengths]])[:-1]
    n = len(texts)
    edges = np.zeros(len(codes) + 1, np.int64)
    pairs: list[np.ndarray] = []
    longest, where, whose = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    known = codes > 0
    if bench.names and known.any():
        # Suffixes that begin with a word of no item match nothing and stay out of the array.
        near = np.flatnonzero(known)
        order = near[sparse_order(codes, near, bench.depth)]
        for depth, at, low, high in bench.search(codes, order):
            whole = bench.need[at] == depth
            longer = (bench.need[at] > 0) & (bench.need[at] <= depth)
            for mark, chosen in ((True, whole), (False, longer)):
                if not chosen.any():
                    continue
                sizes = (high - low)[chosen]
                which = np.repeat(at[chosen], sizes)
                places = order[np.repeat(low[chosen] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                text = np.searchsorted(begin, places, side="right") - 1
                if mark:
                    np.add.at(edges, places, 1)
                    np.add.at(edges, places + depth, -1)
                    pairs.append(np.unique(text * len(bench.names) + bench.item[which]))
                else:
                    best = np.lexsort((bench.item[which], places, text))
                    keep = best[np.append(True, text[best][1:] != text[best][:-1])] if len(best) else best
                    t = text[keep]
                    longest[t], where[t], whose[t] = depth, places[keep] - begin[t], bench.item[which][keep]
    hit = np.cumsum(edges[:-1]) > 0
    step = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    spans: list[list] = [[] for _ in range(n)]
    for a, b in zip(step[::2], step[1::2], strict=True):
        t = int(np.searchsorted(begin, a, side="right")) - 1
        spans[t].append({"start": int(a - begin[t]), "end": int(b - begin[t])})
    items: list[list] = [[] for _ in range(n)]
    for pair in np.unique(np.concatenate(pairs)) if pairs else ():
        items[pair // len(bench.names)].append(bench.names[pair % len(bench.names)])
    return [(lengths[t], spans[t], items[t], int(longest[t]), int(where[t]) if longest[t] else None, bench.names[whose[t]] if longest[t] else None) for t in range(n)]


def sparse_order(codes: np.ndarray, near: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array over the stretches of known words only: words of no item cut the text, and each cut is one smallest code."""
    gap = np.diff(near) > 1
    packed = np.zeros(len(near) + int(gap.sum()) + 1, np.int64)
    slot = np.arange(len(near)) + np.concatenate(([0], np.cumsum(gap)))
    packed[slot] = codes[near]
    order = suffix_array(packed, depth)
    back = np.full(len(packed), -1, np.int64)
    back[slot] = np.arange(len(near))
    order = back[order]
    return order[order >= 0]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows gathered up to about SHARD_WORDS words (six bytes a word), from slices of few rows."""
    held, size = [], 0
    for batch in slices(batches):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= 6 * SHARD_WORDS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list:
    """Broadcasts of the benchmark's (item, text) rows, of about BLOCK_CHARS characters each."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    parts = [items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]
    return [benchmark.sparkSession.sparkContext.broadcast(sorted((r.item, r.text) for r in p.toLocalIterator())) for p in parts]


def joined(parts: list[tuple]) -> tuple:
    """What several blocks found in one text as one result: spans merged, items joined, the longest match (ties: first place, then first item)."""
    spans: list[dict] = []
    for s in sorted((s for p in parts for s in p[1]), key=lambda s: s["start"]):
        if spans and spans[-1]["end"] >= s["start"]:
            spans[-1]["end"] = max(spans[-1]["end"], s["end"])
        else:
            spans.append(dict(s))
    best = min((p for p in parts if p[3]), key=lambda p: (-p[3], p[4], p[5]), default=parts[0])
    return parts[0][0], spans, sorted({i for p in parts for i in p[2]}), *best[3:]


def searched(rows: DataFrame, blocks: list, window: int) -> DataFrame:
    """Matches of all blocks in rows(id, text, ...), each row by itself; further columns are carried along.

    Each shard goes through the blocks one after another. Of several blocks a task holds one at a time, made anew for each shard.
    """
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "text"], *FOUND])

    def made(block) -> Benchmark:
        bench = Benchmark(block.value, window)
        vars(block).pop("_value", None)  # the rows, which Spark would keep in the worker
        return bench

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = made(blocks[0]) if len(blocks) == 1 else None
        for shard in shards(batches):
            texts = shard.column("text").to_pylist()
            if one:
                got = shard_hits(texts, one)
            else:
                got = [joined(parts) for parts in zip(*(shard_hits(texts, made(b)) for b in blocks), strict=True)]
            found = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(ARROW)]
            rest = shard.drop_columns("text")
            yield from pa.Table.from_arrays([*rest.columns, *found], [*rest.column_names, *FOUND.names]).to_batches()

    return rows.mapInArrow(run, schema)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, spans (merged, in words, end exclusive), items, longest, longest_at, longest_item.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Each task builds
    suffix arrays over shards of its documents and searches every suffix of every item by binary search; a match of at least a
    whole window is reported as a span, and the longest verbatim match with its place and item (ties: first place, then first
    item). Documents are never shuffled. A benchmark beyond BLOCK_CHARS is searched in blocks, whose results are merged row by row
    in the task that reads the row, so the benchmark's size changes no result.

    Null and empty texts have no words and no matches; null item ids count as items named ``null``; an empty benchmark matches
    nothing. Repeated documents are judged each for itself; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return searched(rows, item_blocks(benchmark, item_col, item_text_col), window).withColumnRenamed("id", id_col)


def contamination(matches: DataFrame, one_in: int = 20) -> DataFrame:
    """Add n_hit (words inside any span), n_items and contaminated (hit, and at least one word in ``one_in``)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long"))
    return matches.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 20) -> DataFrame:
    """The input's rows and columns without contaminated documents; each row is judged where it is read, and nothing is shuffled."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id"), F.col(text_col).alias("text"))
    found = searched(rows, item_blocks(benchmark, "item_id", "text"), WINDOW)
    return contamination(found, one_in).where("not contaminated").select("id.*")
