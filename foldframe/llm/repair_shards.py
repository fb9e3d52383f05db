"""Token-id shards: public tokenizer ids in document order, compressed by Re-Pair grammars that decode from any place."""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldframe.llm.work import Work, slices

MAGIC = b"RPR1"
#: Ids of a shard; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
#: A pair becomes a rule while it occurs this often in its shard.
LEAST = 128
#: Symbols between two entries of a shard's index.
STRIDE = 1024
#: A single blank between two visible characters; and a blank or line end that does not stand so.
BORDER, DOUBT = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"[ \n](?:(?!\S)|(?<!\S[ \n]))")
#: A word of letters that are letters to every version of Unicode, with one mark behind it or none.
WORD = re.compile("(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]?)\\Z")
CACHE_ENTRIES = 1_000_000


# ---------------------------------------------------------------- encoding


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, which sees every distinct chunk once while it is remembered.

    Byte-level vocabularies cut a text before a single blank that stands between two visible characters, whatever is around it, and
    merge within the cut pieces only; a single line end between visible characters is a piece of its own. So the ids of a text are those of its chunks
    between such places, one after the other. Texts with other blanks or line ends are cut at the undoubted blanks alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.width = np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.width is np.uint16 else "I"
        self.merged = self.lib.model.tokenize
        # Byte-level vocabularies write a byte as a visible character: itself, or one from 256 on in order of the rest.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) if b in plain else chr(256 + hidden.index(b)) for b in range(256)}
        self.marks = {m: array(self.code, self.lib.encode(m, add_special_tokens=False).ids).tobytes() for m in ".,;:!?"}
        self.line_end = array(self.code, self.lib.encode("\n", add_special_tokens=False).ids).tobytes()
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # first chunks of texts, and those behind a blank or line end

    def learn(self, kind: int, chunks: list[str]) -> None:
        """Remember the ids of chunks: words of letters go to the library's model as they are, one piece each; anything else goes through all of the library."""
        known, need, rest = self.known[kind], {}, []
        for c in chunks:
            shape = WORD.match(c)
            if shape is None:
                rest.append(c)
            else:
                line, word, mark = shape.groups()
                need.setdefault("\u0120" + word if kind and not line else word, []).append((c, line, mark))
        shown = "\n".join(need).replace("\u0120", " ").encode("utf-8").decode("latin-1").translate(self.alphabet).split(self.alphabet[10]) if need else []
        for uses, name in zip(need.values(), shown, strict=True):
            ids = array(self.code, [t.id for t in self.merged(name)]).tobytes()
            for c, line, mark in uses:
                known[c] = (self.line_end if line else b"") + ids + (self.marks[mark] if mark else b"")
        before = ["" if not kind or c[:1] == "\n" else " " for c in rest]
        for c, e in zip(rest, self.lib.encode_batch_fast([b + c for b, c in zip(before, rest, strict=True)], add_special_tokens=False), strict=True):
            known[c] = array(self.code, e.ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        first, inner = self.known
        if len(first) + len(inner) > CACHE_ENTRIES:
            first.clear()
            inner.clear()
        cut = [BORDER.split(t) if DOUBT.search(t) else t.replace("\n", " \n").split(" ") for t in texts]
        rows = [[first.get(c[0]), *map(inner.get, c[1:])] for c in cut]
        late = [(k, [i for i, r in enumerate(row) if r is None]) for k, row in enumerate(rows) if None in row]
        for kind in (0, 1):
            fresh = {cut[k][i] for k, missing in late for i in missing if (i > 0) == kind}
            if fresh:
                self.learn(kind, sorted(fresh))
        for k, missing in late:
            row, c = rows[k], cut[k]
            for i in missing:
                row[i] = self.known[i > 0][c[i]]
        return [b"".join(row) for row in rows]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- grammar


def chosen_pairs(keys: np.ndarray, counts: np.ndarray, width: int, room: int) -> np.ndarray:
    """Keys (left * width + right) of pairs that can be replaced together, most frequent first.

    Of two pairs that could overlap, that is one ends with the symbol the other starts with, the more frequent stays; ties go to the
    smaller key. A pair of one symbol with itself stands alone. Only pairs at least 1/32 as frequent as the first are taken at once, rarer ones wait
    for the counts after it.
    """
    often = counts * 32 >= counts.max(initial=0)
    keys, counts = keys[often], counts[often]
    out, starts, ends = [], set(), set()
    for key in keys[np.lexsort((keys, -counts))].tolist():
        a, b = divmod(key, width)
        if a in ends or b in starts or (a == b and (a in starts or b in ends)):
            continue
        out.append(key)
        starts.add(a)
        ends.add(b)
        if len(out) == room:
            break
    return np.array(out, np.int64)


def compress(ids: np.ndarray, vocabulary: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule k stands for symbol vocabulary + k and holds its two parts.

    Pairs that occur ``least`` times are replaced, round by round, until there is none or symbols no longer fit 16 bits (32 where the vocabulary does
    not fit 16). Only symbols as frequent as that can be in such a pair; they are numbered, so pairs are counted in a table of all their pairs,
    or by sorting where that table would be larger than the shard. A run of one symbol is paired from its left end.
    """
    seq, rules = ids.astype(np.int32), []
    limit = 1 << 16 if vocabulary <= 1 << 16 else 1 << 31
    while len(seq) > 1 and (room := limit - vocabulary - len(rules)) > 0:
        frequent = np.flatnonzero(np.bincount(seq) >= least)
        width = len(frequent) + 1
        number = np.zeros(int(seq.max()) + 1, np.int64)
        number[frequent] = np.arange(1, width)
        own = number[seq]
        pair = own[:-1] * width + own[1:]
        pair[(own[:-1] == 0) | (own[1:] == 0)] = 0
        if width * width <= 4 * len(seq):
            counts = np.bincount(pair, minlength=width * width)
            counts[0] = 0
            keys = np.flatnonzero(counts >= least)
            counts = counts[keys]
        else:
            keys, counts = np.unique(pair[pair > 0], return_counts=True)
            keys, counts = keys[counts >= least], counts[counts >= least]
        keys = chosen_pairs(keys, counts, width, room)
        if not len(keys):
            break
        order = np.argsort(keys)
        if width * width <= 4 * len(seq):
            rule = np.full(width * width, -1, np.int32)
            rule[keys] = np.arange(len(keys))
            at = np.flatnonzero(rule[pair] >= 0)
            which = rule[pair[at]]
        else:
            place = np.minimum(np.searchsorted(keys[order], pair), len(keys) - 1)
            at = np.flatnonzero(keys[order][place] == pair)
            which = order[place[at]]
        twin = np.flatnonzero(seq[at] == seq[at + 1])
        if len(twin):  # a a a: every second place of a run
            t = at[twin]
            start = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(t) != 1)), np.arange(len(t)), 0))
            keep = np.ones(len(at), bool)
            keep[twin] = (np.arange(len(t)) - start) % 2 == 0
            at, which = at[keep], which[keep]
        seq[at] = vocabulary + len(rules) + which
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        left, right = frequent[keys // width - 1], frequent[keys % width - 1]
        rules.extend(zip(left.tolist(), right.tolist(), strict=True))
    return np.array(rules, np.uint32).reshape(-1, 2), seq.astype(np.uint32)


class Shard:
    """One shard: a grammar, its symbols and an index of expanded places.

    Layout, little-endian: magic, vocabulary, number of rules, symbols, documents (uint32), ids before the shard in its part (uint64),
    bytes per symbol (uint32); rules as pairs of symbols; expansion length of each rule (uint32); symbols; expanded place of
    every STRIDE-th symbol (uint32); ids of each document (uint32); CRC-32 of all before it.
    """

    HEAD = struct.Struct("<4sIIIIQI")

    def __init__(self, blob: bytes):
        if zlib.crc32(blob[:-4]) != struct.unpack("<I", blob[-4:])[0]:
            raise ValueError("a shard is damaged")
        magic, self.vocabulary, n_rules, n, docs, self.first, wide = self.HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at, kind = self.HEAD.size, np.dtype(f"<u{wide}")

        def take(count: int, dtype) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype, count, at)
            at += out.nbytes
            return out

        self.rules, self.lengths = take(2 * n_rules, kind).reshape(-1, 2), take(n_rules, "<u4")
        self.symbols, self.index, self.sizes = take(n, kind), take(-(-n // STRIDE), "<u4"), take(docs, "<u4")

    @staticmethod
    def pack(ids: np.ndarray, sizes: list[int], vocabulary: int, first: int, least: int = LEAST) -> bytes:
        rules, symbols = compress(ids, vocabulary, least)
        lengths = np.ones(vocabulary + len(rules), np.uint32)
        for k, (a, b) in enumerate(rules.tolist(), vocabulary):
            lengths[k] = lengths[a] + lengths[b]
        size = lengths[symbols]
        index = (np.cumsum(size, dtype=np.uint64) - size)[::STRIDE].astype("<u4")
        wide = 2 if vocabulary + len(rules) <= 1 << 16 else 4
        head = Shard.HEAD.pack(MAGIC, vocabulary, len(rules), len(symbols), len(sizes), first, wide)
        body = b"".join((head, rules.astype(f"<u{wide}").tobytes(), lengths[vocabulary:].astype("<u4").tobytes(), symbols.astype(f"<u{wide}").tobytes(), index.tobytes(), np.array(sizes, "<u4").tobytes()))
        return body + struct.pack("<I", zlib.crc32(body))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length and place of each symbol's expansion in one array of expansions; rules only refer to earlier ones."""
        if not hasattr(self, "_tables"):
            size = np.concatenate((np.ones(self.vocabulary, np.int64), self.lengths.astype(np.int64)))
            start = np.cumsum(size) - size
            flat = np.empty(int(size.sum()), "<u4")
            flat[: self.vocabulary] = np.arange(self.vocabulary)
            for k, (a, b) in enumerate(self.rules.tolist(), self.vocabulary):
                at, mid = int(start[k]), int(start[k] + size[a])
                flat[at:mid] = flat[start[a] : start[a] + size[a]]
                flat[mid : at + int(size[k])] = flat[start[b] : start[b] + size[b]]
            self._tables = size, start, flat
        return self._tables

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size, start, flat = self.tables()
        n = size[symbols]
        ends = np.cumsum(n)
        return flat[np.repeat(start[symbols] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def decode(self, start: int = 0, count: int | None = None) -> np.ndarray:
        """``count`` ids from place ``start`` of the shard; only the symbols that cover them are expanded."""
        total = int(self.sizes.sum())
        stop = total if count is None else min(total, start + count)
        if start >= stop:
            return np.empty(0, "<u4")
        block = int(np.searchsorted(self.index, start, "right")) - 1
        last = int(np.searchsorted(self.index, stop, "left"))
        got = self.expand(self.symbols[block * STRIDE : last * STRIDE])
        at = start - int(self.index[block])
        return got[at : at + stop - start]


# ---------------------------------------------------------------- tables


def write_shards(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = SHARD_IDS, least: int = LEAST) -> None:
    """Write the ids of all documents in ascending id order as shards: a Parquet table of (part, block, ids, n_ids, payload).

    A row is one shard, ``payload`` its file as described at Shard, ``ids`` its document ids. Parts follow each other in document
    order, blocks within a part too. Null texts count as empty; null ids come first; rows of one id follow by a hash of their text. An
    id that many rows share is spread over parts. Texts are shuffled, and encoded where their shard is made. Whole documents go into a shard until it holds ``shard_ids`` ids.
    """
    spark = docs.sparkSession
    width = np.dtype(encoder(tokenizer).width)
    vocabulary, end = encoder(tokenizer).lib.get_vocab_size(), np.array([end_id], width).tobytes()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("code"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).alias("salt"), text.alias("text"))
    dealt = rows.repartitionByRange(parts, "id", "code", "salt").sortWithinPartitions("id", "code", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        names, held, size = [], [], 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), width)
            blob = Shard.pack(ids, [len(b) // width.itemsize for b in held], vocabulary, before, least)
            cols = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "block", "ids", "n_ids", "payload"])

        for piece in slices(batches):
            for name, ids in zip(piece.column("id").to_pylist(), encode(piece.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // width.itemsize
                if held and size + n > shard_ids:
                    yield shard()
                    block, before, names, held, size = block + 1, before + size, [], [], 0
                names.append(name)
                held.append(ids)
                size += n
        if held:
            yield shard()

    dealt.select("id", "text").mapInArrow(run, "part int, block int, ids array<long>, n_ids long, payload binary").write.parquet(path)


def read_shards(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of a shard table: id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian 32-bit ids).

    A part's first place comes from the sums of the parts before it: one row for each part of the table, however large it is.
    """
    table = spark.read.parquet(path)
    sums = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = sums.select("part", (F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.column("payload")[k].as_py())
                ids = memoryview(np.ascontiguousarray(shard.decode(), "<u4")).cast("B")
                ends = np.cumsum(shard.sizes, dtype=np.int64)
                starts = ends - shard.sizes
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(list(repeat(batch.column("part")[k].as_py(), len(crc))), pa.int32()), batch.column("ids")[k].values, pa.array(starts + shard.first), pa.array(shard.sizes, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "id", "at", "n_tokens", "ids_crc32"])

    docs = table.select("part", "ids", "payload").mapInArrow(run, "part int, id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(base), "part").select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def sharded_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = SHARD_IDS, least: int = LEAST) -> DataFrame:
    """Write the shards of ``docs`` below the shared folder and read every document back from them (see write_shards, read_shards)."""
    work = Work(docs.sparkSession, "shards")
    write_shards(docs, work.path("table"), tokenizer, id_col, text_col, end_id, shard_ids, least)
    return read_shards(docs.sparkSession, work.path("table"), id_col)
