"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library does the merging; the ranks come from a public
vocabulary file whose path is a parameter. Bytes are mapped to printable
characters and back, the usual byte-level trick, and each match of the
splitting pattern is encoded by itself, so that the matches seen before are
looked up and only new ones go through the library.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import extended, fresh

#: Matches and words that a Python worker learns before it forgets those not used since it last did.
MEMORY = 150_000
#: Characters beyond which a match or word isn't remembered, so that memory follows no text.
LONG = 64


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class ByteTable:
    """The decoder for one rank file (``base64-token rank`` lines).

    Tokens are kept as the library writes them, a printable character for each
    byte; decoding joins those and takes the table of characters in reverse.
    """

    def __init__(self, path: str):
        import numpy as np

        with open(path, "rb") as f:
            pairs = [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, f)]
        self.chars = byte_characters()
        self.text_of = [""] * (max(rank for _, rank in pairs) + 1)
        self.byte_of = np.zeros(0x200, dtype=np.uint8)
        for byte, char in enumerate(self.chars):
            self.byte_of[ord(char)] = byte
        for token, rank in pairs:
            self.text_of[rank] = self.mapped(token)
        #: Characters that start in a token, and whether its first and last bytes lie inside one.
        own = [self.decode([i]) for i in range(len(self.text_of))]
        self.starts = np.array([sum(b & 0xC0 != 0x80 for b in t) for t in own], dtype=np.int32)
        self.inside = np.array([bool(t) and t[0] & 0xC0 == 0x80 for t in own])

    def mapped(self, content: bytes) -> str:
        return "".join(map(self.chars.__getitem__, content))

    def decode(self, ids) -> bytes:
        import numpy as np

        text = "".join(map(self.text_of.__getitem__, ids))
        return self.byte_of[np.frombuffer(text.encode("utf-16-le"), dtype=np.uint16)].tobytes()

    def characters(self, ids) -> list[str]:
        """The text each id completes: a character that several tokens share comes whole with the last of them.

        Bytes that are no UTF-8 become U+FFFD; what is open after the last id is an item of its own.
        """
        import codecs

        reader = codecs.getincrementaldecoder("utf-8")("replace")
        out = [reader.decode(self.decode([i])) for i in ids]
        if rest := reader.decode(b"", final=True):
            out.append(rest)
        return out

    def spans(self, ids):
        """First and end code point of each token of a valid text; a token inside a character has that character's span."""
        import numpy as np

        ids = np.asarray(ids, dtype=np.int64)
        ends = np.cumsum(self.starts[ids], dtype=np.int32)
        return ends - self.starts[ids] - self.inside[ids], ends


class ByteBpe(ByteTable):
    """Encoder and decoder.

    The library merges the pair whose result has the lowest rank, as the ranks
    ask for: every way to cut a token into two tokens is a merge, in rank order,
    and a match that is a token as a whole is taken as it is.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models

        import public_tokenizers

        super().__init__(path)
        ranks = {token: rank for rank, token in enumerate(self.text_of) if token}
        self._map = str.maketrans({chr(b): c for b, c in enumerate(self.chars)})
        self.space = self.chars[0x20]
        merges = []
        for token in filter(None, self.text_of):
            cuts = ((token[:i], token[i:]) for i in range(1, len(token)))
            merges += sorted((c for c in cuts if c[0] in ranks and c[1] in ranks), key=lambda c: ranks[c[0]])
        self.model = Tokenizer(models.BPE(vocab=ranks, merges=merges, ignore_merges=True)).model
        self.split = regex.compile(pattern).findall
        self.by_words = pattern == public_tokenizers.PATTERN
        self.seen: dict[str, bytes] = {}
        self.words: dict[str, bytes | None] = {}
        self.old_seen, self.old_words = self.seen, self.words

    def piece(self, piece: str) -> bytes:
        """Ids of one match of the pattern, as int32 bytes."""
        if len(piece) > LONG:
            return self._merged(piece)
        ids = self.seen.get(piece)
        if ids is None:
            ids = self.old_seen.get(piece)
            if ids is not None:
                self.seen[piece] = ids
                return ids
            ids = self.seen[piece] = self._merged(piece)
        return ids

    def _merged(self, piece: str) -> bytes:
        word = piece.encode().decode("latin-1").translate(self._map)  # bytes to characters
        return array("i", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _slowly(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def _word(self, word: str) -> bytes | None:
        """Ids of a space and ``word``, or None where the cut at that space isn't safe."""
        ids = self.old_words.get(word, 0)
        if ids == 0:
            if word.isascii() and word.isalpha():  # one match under these patterns, and its bytes are their own characters
                ids = array("i", [t.id for t in self.model.tokenize(self.space + word)]).tobytes()
            else:
                ids = None if not word or word[0].isspace() or word[-1].isspace() else self._slowly(" " + word)
        if len(word) <= LONG:
            self.words[word] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """Ids as int32 bytes.

        A single space between two characters that aren't white space always
        starts a match under the default pattern (no alternative runs from
        other characters into a space), so that the words between such spaces
        can be encoded by themselves and remembered; texts with other uses of
        the space, and all texts under other patterns, are split as a whole.
        """
        if len(self.words) + len(self.seen) > MEMORY:
            self.old_seen, self.old_words = self.seen, self.words
            self.seen, self.words = {}, {}
        first, *words = text.split(" ")
        if not self.by_words or not words or not first or first[-1].isspace():
            return self._slowly(text)
        get = self.words.get
        found = [get(w, 0) for w in words]
        if 0 in found:
            found = [self._word(w) if x == 0 else x for w, x in zip(words, found, strict=True)]
        return self._slowly(text) if None in found else self._slowly(first) + b"".join(found)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    """One coder for each vocabulary and Python worker."""
    return ByteBpe(path, pattern)


@lru_cache(maxsize=2)
def table(path: str) -> ByteTable:
    return ByteTable(path)


def _known(vocabulary: str, pattern: str | None) -> tuple[str, str]:
    """The workers find the file by its name: a path, or a file of the public tokenizers."""
    import os

    import public_tokenizers

    return vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary), pattern or public_tokenizers.PATTERN


def _lists(values: list, type_):
    """An Arrow list array from numpy arrays."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type_))


def _texts(values) -> list[str]:
    return [x or "" for x in values.to_pylist()]


def _encoded(own: ByteBpe, texts: list[str]) -> list:
    import numpy as np

    return [np.frombuffer(own.encode_bytes(t), dtype=np.int32) for t in texts]


def _offsets(own: ByteTable, coded: list):
    """An Arrow array of lists of spans (start, end)."""
    import numpy as np
    import pyarrow as pa

    ends = pa.array(np.cumsum([0, *map(len, coded)]).astype(np.int32))
    first, last = zip(*map(own.spans, coded), strict=True) if coded else ((), ())
    flat = [pa.array(np.concatenate(x) if x else np.empty(0, np.int32), pa.int32()) for x in (first, last)]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, names=["start", "end"]))


OFFSETS = "array<struct<start:int,end:int>>"


def encode(docs: DataFrame, vocabulary: str, *, text_col: str = "text", pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """``docs`` plus ``token_ids`` and, if asked for, ``token_offsets``.

    Null texts encode like empty ones, to no ids. Names that clash get a
    leading underscore. Very long texts are encoded whole; repeated rows are
    rows of their own; an empty table gives an empty result. ``token_offsets``
    are code-point spans (start, end); a token inside a character has that
    character's span.
    """
    ids, spans = fresh(docs, "token_ids", "token_offsets")

    def start():
        import pyarrow as pa

        own = coder(*_known(vocabulary, pattern))

        def work(values):
            coded = _encoded(own, _texts(values))
            return [_lists(coded, pa.int32()), *([_offsets(own, coded)] if offsets else [])]

        return work

    return extended(docs, text_col, start, **{ids: "array<int>"} | ({spans: OFFSETS} if offsets else {}))


def decode(docs: DataFrame, vocabulary: str, *, ids_col: str = "token_ids") -> DataFrame:
    """``docs`` plus ``decoded`` (binary), the bytes of the ids, and ``decoded_text``.

    The text is read by an incremental decoder, so that characters whose bytes
    lie in several tokens come out whole; bytes that are no UTF-8 (ids cut out
    of a longer list) become U+FFFD. Null ids give no bytes.
    """
    names = fresh(docs, "decoded", "decoded_text")

    def start():
        import pyarrow as pa

        own = table(_known(vocabulary, None)[0])

        def work(values):
            ids = values.to_pylist()
            return [pa.array([own.decode(x or ()) for x in ids], pa.binary()), pa.array(["".join(own.characters(x or ())) for x in ids], pa.string())]

        return work

    return extended(docs, ids_col, start, **dict(zip(names, ("binary", "string"), strict=True)))


def encode_and_decode(docs: DataFrame, vocabulary: str, *, text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """``docs`` plus ``token_ids``, ``token_offsets`` and ``decoded``: :func:`encode`, then
    :func:`decode` of the ids to bytes, in one pass through one worker."""
    ids, spans, name = fresh(docs, "token_ids", "token_offsets", "decoded")

    def start():
        import pyarrow as pa

        own = coder(*_known(vocabulary, pattern))

        def work(values):
            coded = _encoded(own, _texts(values))
            return [_lists(coded, pa.int32()), _offsets(own, coded), pa.array([own.decode(x.tolist()) for x in coded], pa.binary())]

        return work

    return extended(docs, text_col, start, **{ids: "array<int>", spans: OFFSETS, name: "binary"})
