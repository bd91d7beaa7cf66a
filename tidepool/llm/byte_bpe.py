"""Byte-level BPE as a monoid: texts are encoded by halves and joined at their borders.

Encoding. A piece of up to LEAF characters is a leaf. A longer text is halved, recursively, and neighbours are joined by
re-encoding a window round the border that grows until both its ends are *stable*: a place between a visible character
and white space that follows it. No match of the split pattern spans such a place and none looks past it to the left, so
that tokens before the window and after it are those of the whole text; only the window's are made anew.

Within one match (a run without inner white space may be arbitrarily long) the same scheme works on bytes: a piece of up
to LEAF_BYTES is a leaf, and joining re-encodes windows of whole tokens, growing left and moving right, until the pairs
of tokens on both window borders are *compatible*, that is, encoding their joined bytes gives the two back. A sequence of tokens whose neighbours are all
compatible is the encoding of its bytes: the first merge across a token border in the whole would also be made in the
pair alone.

Decoding concatenates the bytes of halves up the same tree.

Null texts count as empty: no tokens. Text that is no valid UTF-8 does not occur in a Spark string. Repeated rows, ties
and extra columns have no effect: rows are independent, and only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import add_columns, doc_text, documents

LEAF = 256
LEAF_BYTES = 512
#: Runs without white space of over so many characters are split into matches here and go through the byte tree.
LONG_RUN = 2048
_BLANK = frozenset(" \t\n\r\v\f")


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, leaf_bytes: int = LEAF_BYTES, long_run: int = LONG_RUN):
        import tiktoken

        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.leaf, self.leaf_bytes = regex.compile(pattern), leaf, leaf_bytes
        self.long_run = regex.compile(r"\S{%d,}" % long_run)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.ranks = ranks

    # one match of the pattern: the byte tree
    def _single(self, piece: bytes) -> list[int]:
        own = self.ranks.get(piece)
        return [own] if own is not None else self.coder._core_bpe.encode_single_piece(piece)

    def _compatible(self, a: int, b: int) -> bool:
        return self._single(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_pieces(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the two token sequences' joined bytes. The window moves right for as long as its right border isn't compatible."""
        out, at = list(left), 0
        while at < len(right) and out and not self._compatible(out[-1], right[at]):
            reach = 1
            while True:
                a, b = max(0, len(out) - reach), min(len(right), at + reach)
                window = self._single(b"".join(self.bytes_of[t] for t in out[a:] + right[at:b]))
                if not a or self._compatible(out[a - 1], window[0]):
                    break
                reach *= 2
            out[a:] = window
            at = b
        return out + right[at:]

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self._single(piece) if piece else []
        half = len(piece) // 2
        return self.join_pieces(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    # texts
    def _plain(self, text: str) -> np.ndarray:
        """A leaf or a window. Long runs without white space are cut out at stable places and split into matches here."""
        if len(text) > 512 and self.long_run.search(text):
            out: list[int] = []
            for m in self.pattern.finditer(text):
                out += self.encode_piece(m[0].encode("utf-8", "surrogatepass"))
            return np.array(out, dtype=np.uint32)
        return np.asarray(self.coder.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)

    @staticmethod
    def _stable_left(text: str, at: int, low: int) -> int:
        """The last stable place at or before ``at``; low if there is none."""
        while at > low and not (text[at] in _BLANK and not text[at - 1].isspace()):
            at -= 1
        return at

    @staticmethod
    def _stable_right(text: str, at: int, high: int) -> int:
        while at < high and not (text[at] in _BLANK and not text[at - 1].isspace()):
            at += 1
        return at

    def _tree(self, text: str, low: int, high: int) -> np.ndarray:
        if high - low <= self.leaf:
            return self._plain(text[low:high])
        mid = (low + high) // 2
        left, right = self._tree(text, low, mid), self._tree(text, mid, high)
        reach = 16
        a, b = self._stable_left(text, max(low, mid - reach), low), self._stable_right(text, min(high, mid + reach), high)
        old_left, old_right = self._plain(text[a:mid]), self._plain(text[mid:b])
        n, m = len(left) - len(old_left), len(old_right)
        # a and b are stable in the whole text, so the halves have exactly these tokens there; were they not, the window would grow
        while not (np.array_equal(left[n:], old_left) and np.array_equal(right[:m], old_right)):
            reach *= 4
            a, b = self._stable_left(text, max(low, mid - reach), low), self._stable_right(text, min(high, mid + reach), high)
            old_left, old_right = self._plain(text[a:mid]), self._plain(text[mid:b])
            n, m = len(left) - len(old_left), len(old_right)
        return np.concatenate([left[:n], self._plain(text[a:b]), right[m:]])

    def encode(self, text: str) -> np.ndarray:
        return self._tree(text, 0, len(text))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.coder.decode_bytes(ids.tolist()) if len(ids) else b""
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) }, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers as binary), decoded (bytes of the decoded ids)."""

    def make():
        own = codec(*(vocabulary or default_vocabulary()))

        def one(texts: list[str]) -> list[pa.Array]:
            ids = [own.encode(t) for t in texts]
            return [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())]

        return one

    return add_columns(doc_text(docs), ["text"], "ids binary, decoded binary", make).drop("text")


def digests(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Length and hashes of what encode() gives, made where the ids are so that they needn't leave the task."""

    def make():
        own = codec(*(vocabulary or default_vocabulary()))

        def one(texts: list[str]) -> list[pa.Array]:
            n, a, d = [], [], []
            for t in texts:
                ids = own.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(own.decode(ids)).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]

        return one

    return add_columns(doc_text(docs), ["text"], "n_tokens long, ids_sha256 string, decoded_sha256 string", make).drop("text")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir, "doc_id", "text"))
