"""Encoding and decoding with merge-type SentencePiece vocabularies: a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldframe.llm.work import slices

SPACE = "▁"
#: Stands before a chunk that is shown to the library, so that the dummy prefix does not touch it; no longer piece holds this character.
GUARD = "\x01"
#: Entries of each of the two generations of a worker's cache.
CACHE_ENTRIES = 350_000
TEXTS_AT_ONCE = 64
#: Up to so many characters the agenda is a plain list, beyond a heap.
LIST_AGENDA = 48
NEVER = float("inf")


def borders(pieces: list[str]) -> re.Pattern:
    """Cuts text into chunks that no merge crosses: blanks with what stands behind them, up to the next blank and, where the pieces
    allow it, letters apart from other characters.

    A merge across a border would be a piece that holds both its sides. Letters are what Python's patterns call letters, without
    characters of pieces (such as superscript digits) that are none by Unicode.
    """
    odd = "".join(sorted({c for p in pieces for c in p if not c.isalpha() and re.match(r"[^\W\d_]", c)}))
    letter = f"[^\\W\\d_{SPACE}{re.escape(odd)}]"
    kinds = [[re.match(letter, c) is not None for c in p.lstrip(SPACE)] for p in pieces]
    if any(len(set(k)) > 1 for k in kinds):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    return re.compile(f"{SPACE}*(?:{letter}+|(?:(?!{letter})[^{SPACE}])+)|{SPACE}+")


class MergeCoder:
    """Exact encoder for a SentencePiece model of merge (BPE) type with byte fallback, dummy prefix and no normalisation.

    A chunk starts as single characters. The agenda holds every adjacent pair whose join is a piece, ordered by the piece's
    score and then by place; the best pair is joined and its new neighbours enter the agenda. What is left outside the vocabulary
    becomes byte pieces. Every chunk not in the cache is compared with the library both ways, in one call per part of an Arrow slice.
    The cache holds ids as packed 32-bit numbers in two generations: when the young one is full it becomes the old one, and what is
    met again moves to the young one, so frequent chunks stay.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        self.piece = {names[i]: i for i in range(size) if not special[i]}
        self.rank = {names[i]: -lib.get_score(i) for i in range(size) if not special[i]}
        self.byte = {int(names[i][1:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        crossing = [p for p in self.piece if re.search(f"[^{SPACE}]{SPACE}", p)]
        if crossing:
            raise ValueError(f"pieces with an inner blank are not supported: {crossing[:3]}")
        if any(GUARD in p and p != GUARD for p in self.piece):
            raise ValueError("longer pieces with the guard character are not supported")
        self.guard = lib.encode(GUARD)
        self.chunks = borders([*self.piece]).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk."""
        get = self.rank.get
        parts = [*chunk]
        if len(parts) <= LIST_AGENDA:
            agenda = [*map(get, map(add, parts, parts[1:]), repeat(NEVER))]
            while agenda:
                best = min(agenda)
                if best == NEVER:
                    break
                i = agenda.index(best)
                parts[i] += parts.pop(i + 1)
                del agenda[i]
                if i:
                    agenda[i - 1] = get(parts[i - 1] + parts[i], NEVER)
                if i < len(agenda):
                    agenda[i] = get(parts[i] + parts[i + 1], NEVER)
        else:
            parts = self.merge_long(parts)
        return self.to_ids(parts)

    def merge_long(self, parts: list[str | None]) -> list[str]:
        """The same agenda as a heap, for chunks whose agenda is too long to scan; entries that no longer hold are skipped."""
        get, n = self.rank.get, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        agenda = [(r, i, i + 1, 2) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1], NEVER)) != NEVER]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = parts[left], parts[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != size:
                continue
            parts[left], parts[right] = a + b, None
            after[left] = nxt = after[right]
            pairs = [(before[left], left)]
            if nxt < n:
                before[nxt] = left
                pairs.append((left, nxt))
            for x, y in pairs:
                if x >= 0 and (r := get(both := parts[x] + parts[y], NEVER)) != NEVER:
                    heapq.heappush(agenda, (r, x, y, len(both)))
        return [p for p in parts if p is not None]

    def to_ids(self, parts: list[str]) -> list[int]:
        ids: list[int] = []
        for p in parts:
            hit = self.piece.get(p)
            if hit is not None:
                ids.append(hit)
            elif self.byte:
                ids.extend(self.byte[b] for b in p.encode("utf-8"))
            else:
                ids.append(self.unknown)
        return ids

    def learn(self, chunks: set[str]) -> None:
        """Bring chunks into the young generation: from the old one, or encoded and held against the library."""
        if len(self.young) + len(chunks) > CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        kept = {c: g for c in chunks if (g := self.old.get(c)) is not None}
        self.young.update(kept)
        fresh = [*(chunks - kept.keys())]
        found = [self.merge(c) for c in fresh]
        guard, skip = self.guard, len(self.guard)
        bare = [GUARD + c.replace(SPACE, " ") for c in fresh]
        told, back = self.lib.encode(bare, num_threads=1), self.lib.decode([guard + ids for ids in found], num_threads=1)
        if bare != back or any(ids != other[skip:] for ids, other in zip(found, told, strict=True)):
            raise ValueError(f"agenda and library differ: {[x for x in zip(fresh, found, told, back, strict=True) if x[1] != x[2][skip:] or x[3] != GUARD + x[0].replace(SPACE, ' ')][:3]}")
        sizes = [*map(len, found)]
        packed, at = np.fromiter((i for ids in found for i in ids), np.int32, sum(sizes)).tobytes(), 0
        for c, n in zip(fresh, sizes, strict=True):
            self.young[c] = packed[at : (at := at + 4 * n)]

    def packed(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text: its ids with the end id as 32-bit numbers, and the text decoded from them.

        The library has decoded every chunk to its own characters, so the decoded text is that of the chunks put together.
        """
        out, end = [], np.int32(self.end).tobytes()
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            cut = [self.chunks(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts[at : at + TEXTS_AT_ONCE]]
            rows = [[*map(self.young.get, cs)] for cs in cut]
            fresh = {c for cs, row in zip(cut, rows, strict=True) if None in row for c, g in zip(cs, row, strict=True) if g is None}
            if fresh:
                self.learn(fresh)
            for cs, row in zip(cut, rows, strict=True):
                if None in row:
                    row = [self.young[c] if g is None else g for c, g in zip(cs, row, strict=True)]
                row.append(end)
                out.append((b"".join(row), "".join(cs)[1:].replace(SPACE, " ")))
        return out

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """For each text: its ids with the end id, and the text decoded from them."""
        return [(np.frombuffer(ids, np.int32).tolist(), text) for ids, text in self.packed(texts)]

    def decode(self, ids: list[int]) -> str:
        """Text of any list of ids, by the library: blanks for their marks, bytes gathered into UTF-8, control ids left out."""
        return self.lib.decode(ids)


_coders: dict[str, MergeCoder] = {}


def coder(model_path: str) -> MergeCoder:
    """One coder for each model and Python worker; its cache lives as long as the worker."""
    if model_path not in _coders:
        _coders[model_path] = MergeCoder(model_path)
    return _coders[model_path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (with the end id, never sampled), decoded.

    A null or empty text gives the end id alone and an empty decoded text. Ids may be null or repeated; other columns are not
    read. Texts pass whole, one Arrow slice at a time; nothing is shuffled. ``model_path`` must exist on every executor.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(model_path)
        for part in slices(batches):
            got = code.packed(part.column("text").to_pylist())
            ends = np.cumsum([0, *(len(g[0]) // 4 for g in got)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(g[0] for g in got), np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("id"), ids, pa.array([g[1] for g in got], pa.string())], [id_col, "ids", "decoded"])

    return rows.mapInArrow(run, schema)
