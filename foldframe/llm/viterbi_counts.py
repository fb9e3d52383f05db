"""Token counts of unigram vocabularies without the tokens: Aho-Corasick matches and a Viterbi pass that carries score and count."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldframe.llm.work import slices

SPACE = "▁"
WORD = re.compile(f"{SPACE}[^{SPACE}]*")
#: What an unknown character scores below the lowest piece (a fixed value of the tokenizer).
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 400_000


class Counter:
    """Pieces with scores; the best segmentation of a word is counted, not built.

    Ties are the tokenizer's: at each end the candidates are taken by their start, the longest piece first, and only a strictly
    better score replaces one; the single unknown character comes last, where no piece is that character. Unknown characters count as
    their UTF-8 bytes if the vocabulary has all byte pieces, else each run of them as one.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.matcher = ahocorasick.Automaton()
        for p, score in reversed(pieces):  # the first of equal pieces holds
            if p:
                self.matcher.add_word(p, (len(p), float(score)))
        self.matcher.make_automaton()
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.seen: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of one word."""
        n = len(word)
        best, count, start = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        loose = [False] * (n + 1)  # ends with an unknown character
        done = 0

        def unknown(end: int) -> None:
            value = self.unknown + best[end - 1]
            if start[end] < 0 or value > best[end]:
                best[end], start[end], loose[end] = value, end - 1, True
                count[end] = count[end - 1] + (len(word[end - 1].encode()) if self.bytes else not loose[end - 1])

        single = True
        for last, (size, score) in self.matcher.iter(word):
            end = last + 1
            if end != done:
                if not single:
                    unknown(done)
                for skipped in range(done + 1, end):
                    unknown(skipped)
                done, single = end, False
            at = end - size
            value = score + best[at]
            if start[end] < 0 or value > best[end]:
                best[end], start[end], loose[end], count[end] = value, at, False, count[at] + 1
            single |= size == 1
        if not single:
            unknown(done)
        for skipped in range(done + 1, n + 1):
            unknown(skipped)
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """(pieces, score) of a whole text, word by word; blanks belong to the word behind them, and the first word has one."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        words = WORD.findall(text if text[0] == SPACE else SPACE + text)
        seen = self.seen
        if len(seen) > CACHE_ENTRIES:
            seen.clear()
        n, score = 0, 0.0
        for w in words:
            got = seen.get(w)
            if got is None:
                got = seen[w] = self.word(w)
            n += got[0]
            score += got[1]
        return n, score


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, best_score (sum of the pieces' scores).

    ``pieces`` is a unigram vocabulary with scores; it is sent to every task once, and its size is that of the tokenizer's file. Words
    begin at blanks, as in a tokenizer that marks and splits at blanks and always adds one in front. Null and empty texts have no
    tokens; ids pass through; whole texts are read and nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(list(pieces))
    key = uuid.uuid4().hex
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("best_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:
            _counters.clear()  # one vocabulary in a worker at a time
            _counters[key] = Counter(sent.value)
        counter = _counters[key]
        for part in slices(batches):
            got = [counter.text(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], [id_col, "n_tokens", "best_score"])

    return rows.mapInArrow(run, schema)


def model_pieces(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece model in order of id."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(lib.id_to_piece(i), lib.get_score(i)) for i in range(lib.get_piece_size())]
