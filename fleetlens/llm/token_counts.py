"""Exact BPE token counts at every prefix of a text.

For each unit (white space and the characters after it) a dynamic programme
over its bytes finds the last token of every prefix: the token that ends there
and is compatible with the last token of the prefix before it, that is, the
two merge to themselves. Exactly one token qualifies, so the count at a prefix
is the count before that token plus one. Units are independent, so a
document's table is the concatenation of its units' tables.

The table holds, for every character, how the count changes when the text is
cut after that character instead of before it. Cutting a text at any length,
or finding how much of it fits a budget, needs sums over the table and no
second encoding.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from operator import sub

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bpe_codec import MEMO_WORDS, slices
from fleetlens.llm.bpe_model import CHUNK, WHITE_SPACE, BpeModel, broadcast_model, model_of, space_pieces

#: Pairs of tokens whose compatibility a worker remembers.
MEMO_PAIRS = 1_000_000
OWN = -1
GAP = re.compile(f"[{WHITE_SPACE}]*")
#: Contractions are words of their own only when whole.
_CONTRACTIONS = {"'re", "'ve", "'ll"}
_ONE = array("i", [1]).tobytes()


class PrefixCounter:
    def __init__(self, model: BpeModel):
        self.model = model
        # Finds every token that ends at each byte, longest first (bytes as Latin-1 letters).
        self._tokens = ahocorasick.Automaton()
        for token, i in model.vocab.items():
            self._tokens.add_word(token.decode("latin-1"), (len(token), i))
        self._tokens.make_automaton()
        # Per token the tokens known to stand behind it (or not); OWN names the token itself.
        self._behind = [{OWN: i} for i in range(len(model.token_bytes))]
        self._known = 0
        self._words: dict[str, list[int]] = {}
        self._pieces: dict[str, bytes] = {}
        # The merge that makes each token: its rank (-1 for a byte) and its two parts.
        self._rank = [-1] * len(model.token_bytes)
        self._left, self._right = list(self._rank), list(self._rank)
        for pair, (rank, made) in model.merges.items():
            self._rank[made], self._left[made], self._right[made] = rank, pair >> 32, pair & 0xFFFFFFFF
        # With two ways to make a token, the parts do not follow from it.
        self._one_way = len({made for _, made in model.merges.values()}) == len(model.merges)

    def _compatible(self, behind: dict[int, int], right: int) -> bool:
        left = behind[OWN]
        if self._known >= MEMO_PAIRS:
            for i, pairs in enumerate(self._behind):
                pairs.clear()
                pairs[OWN] = i
            self._known = 0
        if self._one_way:
            fits = self._never_merge(left, right)
        else:
            table = self.model.token_bytes
            fits = self.model.merge(table[left] + table[right]) == [left, right]
        self._known += 1
        behind[right] = fits
        return fits

    def _never_merge(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens while they are made.

        The merges that made them are undone from the last on. Between two of
        them one token stands on each side of the border; that pair must not
        merge before the later of the two merges undone. Of equal ranks the
        left merge comes first.
        """
        merges, rank = self.model.merges, self._rank
        until = len(merges)
        while True:
            pair = merges.get(left << 32 | right)
            if pair is not None and pair[0] < until:
                return False
            a, b = rank[left], rank[right]
            if a > b:
                until, left = a, self._right[left]
            elif b < 0:
                return True
            else:
                until, right = b + 1, self._left[right]

    def _byte_counts(self, word: bytes) -> list[int]:
        """Token count of every prefix of one word, in bytes."""
        last, count, behind = [None], [0], self._behind
        wanted = 0  # the next byte whose prefix has no last token yet
        for at, (size, token) in self._tokens.iter(word.decode("latin-1")):
            if at != wanted:
                continue
            start = wanted + 1 - size
            if start:
                pairs = last[start]
                fits = pairs.get(token)
                if fits is None:
                    fits = self._compatible(pairs, token)
                if not fits:
                    continue
            wanted += 1
            last.append(behind[token])
            count.append(count[start] + 1)
        return count

    def word_counts(self, word: str) -> list[int]:
        """Token count of the word cut after each of its characters."""
        known = self._words.get(word)
        if known is None:
            if len(self._words) > MEMO_WORDS:
                self._words = {}
            by_byte = self._byte_counts(word.encode())
            if word.isascii():
                known = by_byte[1:]
            else:
                known, at = [], 0
                for c in word:
                    at += len(c.encode())
                    known.append(by_byte[at])
            if word in _CONTRACTIONS:  # cut short, the quote and the letter are two words
                known[1] = self.word_counts(word[0])[-1] + self.word_counts(word[1])[-1]
            self._words[word] = known
        return known

    def unit_counts(self, unit: str) -> list[int]:
        """Counts within a run of white space and the run of other characters after it."""
        gap = GAP.match(unit).end()
        counts = list(self.word_counts(unit[:gap])) if gap else []
        if gap == len(unit):
            return counts
        at = max(gap - 1, 0)
        base = counts[at - 1] if at else 0
        skip = gap - at  # the space already counted as the end of a gap
        for word in self.model.words(unit[at:]):
            own = self.word_counts(word)
            counts.extend([base + n for n in own[skip:]] if base or skip else own)
            base, skip = base + own[-1], 0
        return counts

    def deltas(self, text: str) -> bytes:
        """Change of the count at each character of a text without special strings, 4 bytes each."""
        out = []
        for unit in CHUNK.findall(text):
            before = 0
            for n in self.unit_counts(unit):
                out.append(n - before)
                before = n
        return array("i", out).tobytes()

    def _piece(self, piece: str) -> bytes:
        if len(self._pieces) > MEMO_WORDS:
            self._pieces.clear()
        if piece.isascii() and piece[:-1].isalpha():
            # A space and letters are one word; a full stop or comma behind them is another, of one token.
            if piece.isalpha():
                counts = self._byte_counts(b" " + piece.encode())
                known = array("i", map(sub, counts[1:], counts)).tobytes()
            elif piece[-1] in ".,":
                known = (self._pieces.get(piece[:-1]) or self._piece(piece[:-1])) + _ONE
            else:
                known = self.deltas(f" {piece}")
        else:
            known = self.deltas(f" {piece}")
        self._pieces[piece] = known
        return known

    def table(self, text: str) -> np.ndarray:
        """The whole text's table; special strings count as one token when whole."""
        out = []
        for segment, special in self.model.segments(text):
            pieces = space_pieces(segment)
            if pieces is None:
                out.append(self.deltas(segment))
            else:
                known = self._pieces
                out.append(self.deltas(pieces[0]))
                out.extend([known.get(p) or self._piece(p) for p in pieces[1:]])
            if special is not None:
                name = self.model.token_bytes[special].decode()
                units = CHUNK.findall(segment)
                tail = units[-1] if units else ""
                whole = [self.unit_counts(tail)[-1] if tail else 0]
                # Cut within the special string, its start is ordinary text after the tail.
                part = np.cumsum(np.frombuffer(self.deltas(tail + name), np.int32))[len(tail) : -1].tolist()
                out.append(np.diff([*whole, *part, whole[0] + 1]).astype(np.int32).tobytes())
        return np.frombuffer(b"".join(out), np.int32)


def _packed(table: np.ndarray) -> tuple[bytes, int]:
    """The table in the narrowest of 1, 2 and 4 bytes a character that holds it."""
    for width in (1, 2, 4):
        bound = 1 << (8 * width - 1)
        if not len(table) or (table.min() >= -bound and table.max() < bound):
            return table.astype(f"<i{width}").tobytes(), width
    raise OverflowError("token count changes by more than 2^31 at one character")


def prefix_counts(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None, keep_table: bool = True
) -> DataFrame:
    """The token count at every prefix of every whole text.

    Returns one row per row of `docs`: the id column, n_bytes (UTF-8), n_tokens
    (of the whole text), prefix_table (binary, one signed little-endian integer
    of prefix_width bytes per character). ``tokens_at`` and ``fitting_chars``
    answer questions from the table. With a ``budget`` the column
    chars_in_budget holds what ``fitting_chars`` gives for it, found while the
    table is at hand; ``keep_table=False`` then leaves the table out (null).

    Null and empty texts have an empty table and no tokens. Special strings in
    a text count as the library counts them. Repeated rows, ties and null ids
    are kept as they come; other columns are not read; an empty table of
    documents gives no rows.
    """
    model = broadcast_model(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model_of(model.value))
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tables = [counter.table(t) for t in texts]
            packed = [_packed(t) if keep_table else (None, None) for t in tables]
            fits = [None if budget is None else _fitting(np.cumsum(t, dtype=np.int64), budget) for t in tables]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(0),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array([int(t.sum(dtype=np.int64)) for t in tables], pa.int64()),
                    "prefix_table": pa.array([p for p, _ in packed], pa.binary()),
                    "prefix_width": pa.array([w for _, w in packed], pa.int32()),
                    "chars_in_budget": pa.array(fits, pa.int64()),
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_tokens long, prefix_table binary, prefix_width int, chars_in_budget long"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = source.mapInArrow(run, schema)
    return (counted if budget is not None else counted.drop("chars_in_budget")).withColumnRenamed("id", id_col)


def _fitting(counts: np.ndarray, budget: int) -> int:
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _counts(table: bytes, width: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(table, f"<i{width}"), dtype=np.int64)


def tokens_at(n_chars: Column) -> Column:
    """Tokens of the text cut after `n_chars` characters (at its end if it is shorter)."""

    @F.pandas_udf("long")
    def at(table: pd.Series, width: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(t, f"<i{w}")[: max(int(k), 0)].sum(dtype=np.int64)) for t, w, k in zip(table, width, n)], dtype="int64")

    return at(F.col("prefix_table"), F.col("prefix_width"), n_chars.cast("long"))


def fitting_chars(budget: Column) -> Column:
    """The most characters of the text that `budget` tokens hold.

    The longest such prefix, since a longer prefix may need fewer tokens than
    a shorter one.
    """

    @F.pandas_udf("long")
    def fit(table: pd.Series, width: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([_fitting(_counts(t, w), m) for t, w, m in zip(table, width, most)], dtype="int64")

    return fit(F.col("prefix_table"), F.col("prefix_width"), budget.cast("long"))
