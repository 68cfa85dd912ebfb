"""BPE encoding and decoding with a compiled lexicon of frequent words.

1. Words of all texts are counted (a word is a piece between spaces, with the
   space before it); each task combines its own counts before the shuffle.
2. The most frequent `lexicon_words` become a minimal acyclic transducer with
   their ids as outputs (`bpe_lexicon`), compiled on the driver. Its size has
   the bound lexicon_words x MAX_WORD_BYTES x (an arc and an id), so it is
   broadcast; each worker maps it from an unlinked file.
3. Each task encodes its rows: a word's ids come from the lexicon, those of
   unseen words from an exact merge. The lexicon saves work only: ids never
   depend on what it holds, nor on how rows were dealt.

No step holds more than one Arrow batch and a memo of bounded size.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.bpe_lexicon import Lexicon, compile_lexicon, mapped
from fleetlens.llm.bpe_model import CHUNK, BpeModel, broadcast_model, model_of, space_pieces
from fleetlens.llm.scratch import stored

#: Longer words are not put in the lexicon; they merge when they occur.
MAX_WORD_BYTES = 32
#: Words that a worker remembers, and distinct words that a task counts, before it starts anew.
MEMO_WORDS = 300_000
#: Rows taken from an Arrow batch at a time.
SLICE_ROWS = 256


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts: pieces after a space, without that space."""

    def count(batches):
        def flushed(seen):
            return pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

        seen = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(text.split(" "))
            if len(seen) > MEMO_WORDS:
                yield flushed(seen)
                seen = Counter()
        yield flushed(seen)

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    short = parts.where((F.octet_length("word") < MAX_WORD_BYTES) & (F.col("word") != ""))
    return short.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, limit: int, text_col: str = "text") -> list[str]:
    """The most frequent words that repeat: all at or above the least frequency that at most `limit` reach.

    The frequency is found from the number of words at each frequency, so no
    task sorts words and the driver gets `limit` of them at most.
    """
    counted = stored(word_counts(docs, text_col).where("n > 1"), "words")
    at_each = counted.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    reaching = at_each.select("n", F.sum("c").over(Window.orderBy(F.col("n").desc())).alias("above"))
    least = reaching.where(F.col("above") <= limit).agg(F.min("n")).first()[0]
    return [] if least is None else [r.word for r in counted.where(F.col("n") >= least).select("word").collect()]


def lexicon_of(words: Iterable[str], model: BpeModel) -> bytes:
    """Compiled lexicon of the words, each with the space before it."""
    entries = []
    for w in words:
        text = f" {w}"
        if not any(s in text for s in model.special):
            entries.append((text.encode(), [i for x in model.words(text) for i in model.merge(x.encode())]))
    return compile_lexicon(entries)


class Encoder:
    """Text to ids (little-endian unsigned 32-bit) and back, for one task."""

    def __init__(self, model: BpeModel, lexicon: Lexicon):
        self.model, self.lexicon = model, lexicon
        self._pieces: dict[str, bytes] = {}  # piece after a space -> ids of both
        self._words: dict[str, bytes] = {}

    def _merged(self, texts: list[str]) -> list[bytes]:
        """Exact ids of texts that the lexicon does not hold, word by word."""
        split = [self.model.words(t) for t in texts]
        known = self._words
        new = list({w for words in split for w in words if w not in known})
        known.update(zip(new, self.model.merge_many([w.encode() for w in new])))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def learn(self, pieces: Iterable[str]) -> None:
        """Ids of the pieces not yet known: from the lexicon, else by an exact merge."""
        if len(self._pieces) > MEMO_WORDS:
            self._pieces = {}
        if len(self._words) > MEMO_WORDS:
            self._words = {}
        new = [p for p in pieces if p not in self._pieces]
        at = self.lexicon.index([f" {p}".encode() for p in new]).tolist()
        unseen = [p for p, k in zip(new, at) if k < 0]
        self._pieces.update((p, self.lexicon.ids_bytes(k)) for p, k in zip(new, at) if k >= 0)
        self._pieces.update(zip(unseen, self._merged([f" {p}" for p in unseen])))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            parts = []
            for segment, special in self.model.segments(text):
                pieces = space_pieces(segment)
                if pieces is None:
                    # White space that pieces share: units with all the space before them.
                    parts.extend(self._unit(c) for c in CHUNK.findall(segment))
                else:
                    parts.append((None, pieces[0]))
                    parts.append((pieces[1:], None))
                if special is not None:
                    parts.append((None, np.array([special], dtype="<u4").tobytes()))
            split.append(parts)
        self.learn({p for parts in split for pieces, _ in parts if pieces for p in pieces})
        lone = list({x for parts in split for _, x in parts if isinstance(x, str)})
        alone = dict(zip(lone, self._merged(lone)))
        known = self._pieces.__getitem__
        out = []
        for parts in split:
            ids = []
            for pieces, x in parts:
                if pieces is not None:
                    ids.extend(map(known, pieces))
                else:
                    ids.append(x if isinstance(x, bytes) else alone[x])
            out.append(b"".join(ids))
        return out

    @staticmethod
    def _unit(chunk: str) -> tuple[list[str] | None, str | None]:
        after_space = chunk[0] == " " and len(chunk) > 1 and not chunk[1].isspace()
        return ([chunk[1:]], None) if after_space else (None, chunk)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        table = self.model.token_bytes
        return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 65_536, keep_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns one row per row of `docs`: the id column, n_tokens, ids_sha256 (of
    the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the
    decoded text in UTF-8), and with `keep_ids` also `ids` (array<int>).
    `path` names a plain byte-level BPE file of the `tokenizers` library.

    Null and empty texts give no ids (and the digests of no bytes). Long texts
    are encoded whole. Repeated rows and null ids are kept as they come. Other
    columns, whatever their names, are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    model = broadcast_model(spark, path)
    lexicon = spark.sparkContext.broadcast(lexicon_of(frequent_words(docs, lexicon_words, text_col), model_of(model.value)))

    def run(batches):
        coder = Encoder(model_of(model.value), mapped(lexicon.value))
        for batch in slices(batches):
            encoded = coder.encode_many([t or "" for t in batch.column(1).to_pylist()])
            out = {
                "id": batch.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in encoded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in encoded], pa.string()),
            }
            if keep_ids:
                out["ids"] = pa.array([np.frombuffer(x, "<i4") for x in encoded], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id column, text) of rows with an array of ids. A null array gives a null text."""
    model = broadcast_model(encoded.sparkSession, path)

    def run(batches):
        coder = Encoder(model_of(model.value), Lexicon(compile_lexicon([])))
        for batch in slices(batches):
            texts = [None if ids is None else coder.decode(np.array(ids, dtype="<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "text": pa.array(texts, pa.string())})

    kind = encoded.schema[id_col].dataType.simpleString()
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
