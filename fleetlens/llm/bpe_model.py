"""Byte-level BPE read from a public ``tokenizers`` JSON file.

The file is read on the driver and its bytes are broadcast (a vocabulary has a
fixed size), so executors need no copy of it. Text splits into words as the
file's byte-level pre-tokenizer does; a word's ids come from merging its bytes
by rank.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re

import numpy as np
import regex
from pyspark.sql import SparkSession

# The Unicode White_Space characters (as a character class) and
# the splitting pattern of byte-level BPE.
WHITE_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A run of white space with the run of other characters after it.
CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: White space that the piece after the next space would have to share.
_SHARED_SPACE = re.compile(f"[{WHITE_SPACE}](?: |\\Z)")

#: Rank of a pair that does not merge.
NO_RANK = 1 << 40
#: Words of more bytes merge one by one; a matrix of words has so many cells at most.
LONG_WORD, MATRIX_CELLS = 64, 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary, inverted.

    Printable Latin-1 characters stand for themselves, the others take the
    code points from 256 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BpeModel:
    """Vocabulary, merges and special strings of one byte-level BPE file."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or not plain:
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens with options are not supported")
        self.special = special
        self.vocab = {t: i for t, i in vocab.items() if i not in special.values()}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in self.vocab.items():
            self.token_bytes[i] = token
        for text, i in special.items():
            self.token_bytes[i] = text.encode()
        self.byte_id = [vocab.get(bytes([b]), -1) for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (bytes(letters[c] for c in x) for x in (left, right))
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        pairs = sorted((key, rank, new) for key, (rank, new) in self.merges.items())
        self._pairs, self._pair_ranks = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
        self._merged_id = np.zeros(len(pairs), dtype=np.int64)
        self._merged_id[self._pair_ranks] = [p[2] for p in pairs]
        self._words = regex.compile(WORD_PATTERN)
        # Longer special strings first, as a leftmost-longest search finds them.
        self._special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def words(self, text: str) -> list[str]:
        return self._words.findall(text)

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """(ordinary text, id of the special string after it or None) in order."""
        if self._special is None or not any(s in text for s in self.special):
            return [(text, None)]
        out, at = [], 0
        for m in self._special.finditer(text):
            out.append((text[at : m.start()], self.special[m[0]]))
            at = m.end()
        return [*out, (text[at:], None)]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank merges first, leftmost of equals."""
        ids = [self.byte_id[b] for b in word]
        merges = self.merges
        pairs = [merges.get(a << 32 | b) for a, b in zip(ids, ids[1:])]
        while True:
            best, at = None, -1
            for k, p in enumerate(pairs):
                if p is not None and (best is None or p[0] < best[0]):
                    best, at = p, k
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = merges.get(ids[at - 1] << 32 | ids[at])
            if at < len(pairs):
                pairs[at] = merges.get(ids[at] << 32 | ids[at + 1])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NO_RANK for pairs that do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._pair_ranks[at], NO_RANK)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many words at once: ids of each, little-endian unsigned 32-bit.

        Words of like length form a matrix of ids; each round merges the best
        pair of every row that still has one.
        """
        out = [b""] * len(words)
        by_length = sorted((k for k in range(len(words)) if words[k]), key=lambda k: len(words[k]))
        while by_length:
            width = len(words[by_length[-1]])
            low = bisect.bisect_left(by_length, width // 2 + 1, key=lambda k: len(words[k]))
            low = max(low, len(by_length) - max(1, MATRIX_CELLS // width))
            rows, by_length = by_length[low:], by_length[:low]
            if width > LONG_WORD:
                for k in rows:
                    out[k] = np.array(self.merge(words[k]), dtype="<u4").tobytes()
            else:
                self._merge_rows(words, rows, width, out)
        return out

    def _merge_rows(self, words: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        padded = b"".join(words[k].ljust(width, b"\0") for k in rows)
        ids = np.array(self.byte_id, dtype=np.int64)[np.frombuffer(padded, np.uint8).reshape(-1, width)]
        ids = np.hstack([ids, np.zeros((len(rows), 1), dtype=np.int64)])
        lengths = np.array([len(words[k]) for k in rows])
        own, columns = np.array(rows), np.arange(width + 1)
        ranks = np.full(ids.shape, NO_RANK)
        pairs = columns[:-1] < lengths[:, None] - 1
        ranks[:, :-1][pairs] = self._ranks(ids[:, :-1][pairs], ids[:, 1:][pairs])
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            done = best == NO_RANK
            for k, n, row in zip(own[done].tolist(), lengths[done].tolist(), ids[done].astype("<u4")):
                out[k] = row[:n].tobytes()
            if done.all():
                return
            go = ~done
            ids, ranks, lengths, own, at, best = ids[go], ranks[go], lengths[go] - 1, own[go], at[go], best[go]
            each, from_at = np.arange(len(at)), columns >= at[:, None]
            merged = self._merged_id[best]
            ids[:, :-1] = np.where(from_at[:, :-1], ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(from_at[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ids[each, at] = merged
            has = at > 0
            ranks[each[has], at[has] - 1] = self._ranks(ids[each[has], at[has] - 1], merged[has])
            has = at + 1 < lengths
            ranks[each[has], at[has]] = self._ranks(merged[has], ids[each[has], at[has] + 1])
            ranks[each[~has], at[~has]] = NO_RANK


def space_pieces(text: str) -> list[str] | None:
    """Pieces between single spaces if each piece is a unit of its own, else None.

    A piece after a space and that space are split into words alike in every
    text, unless white space before the space joins both (two spaces, a line
    end before a space) or the text ends in white space.
    """
    return None if _SHARED_SPACE.search(text) else text.split(" ")


_MODELS: dict[str, BpeModel] = {}


def load_blob(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def model_of(blob: bytes) -> BpeModel:
    """The model of a file's bytes, parsed once per Python worker."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = BpeModel(blob)
    return _MODELS[key]


def broadcast_model(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load_blob(path))
