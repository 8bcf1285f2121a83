"""Byte-level BPE through a sentencepiece model written from a vocabulary of ranks.

The model holds every token as a piece of byte characters (one printable character for each byte) with the negative rank
as its score, so that sentencepiece's best-scoring merge is the lowest-ranked one; the normaliser is the identity. Texts are
split by the vocabulary's pattern, each match is encoded on its own, and ids are decoded by mapping pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, read

#: Pre-tokens, and characters of them, that a Python worker remembers; beyond either it starts anew.
CACHE_TOKENS, CACHE_CHARS = 60_000, 4_000_000
#: Fixed value: the public pattern that splits texts before the merges. With it a space begins a match wherever no white space adjoins it.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text encoded together.
BLOCK_BYTES = 1_000_000


def byte_characters() -> list[str]:
    """One printable character per byte: itself where it is printable Latin-1, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in pairs] != [*range(len(pairs))]:
        raise ValueError(f"ranks of {path} have gaps")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def inverse_pieces(vocabulary: str) -> list[bytes]:
    """Bytes of each id, from the pieces of the model that is made of the vocabulary."""
    import sentencepiece

    return piece_bytes(sentencepiece.SentencePieceProcessor(model_proto=serialise_model(read_ranks(vocabulary))))


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece it must have comes last."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes in a Python worker."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern, self.spaced = regex.compile(pattern), pattern == SPACED_PATTERN
        self.to_chars = dict(enumerate(byte_characters()))
        self.tokens = {t: struct.pack("<I", i) for i, t in enumerate(piece_bytes(self.model))}
        self.known: dict[str, bytes] = {}  # ids of matches
        self.words: dict[str, bytes] = {}  # ids of a space and the word
        self.chars = 0  # of the keys of both

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        By SPACED_PATTERN a space between two characters that aren't white space always begins a match, so a text is cut there and the
        ids of the words between are remembered; a text with other white space around a space is matched as a whole, as all are by
        other patterns.
        """
        if len(self.known) > CACHE_TOKENS or len(self.words) > CACHE_TOKENS or self.chars > CACHE_CHARS:
            self.known, self.words, self.chars = {}, {}, 0
        out: list[bytes | None] = []
        split, whole, firsts, unknown = [], [], [], set()
        for t in texts:
            words = t.split(" ") if self.spaced else []
            new = {w for w in words[1:] if w not in self.words}
            cut = len(words) > 1 and words[0] == words[0].rstrip() != "" and all(w and w == w.strip() for w in new)
            split.append(words if cut else None)
            if cut:
                unknown |= new
                firsts.append(words[0])
            else:
                whole.append(t)
        first_ids, whole_ids = iter(self._matches(firsts)), iter(self._matches(whole))
        letters = [w for w in unknown if w.isalpha()]  # a space and letters are one match
        others = [w for w in unknown if not w.isalpha()]
        self.words.update(zip(letters, self._encoded([" " + w for w in letters]), strict=True))
        self.words.update(zip(others, self._matches([" " + w for w in others]), strict=True))
        self.chars += sum(map(len, unknown))
        for words in split:
            out.append(next(whole_ids) if words is None else b"".join([next(first_ids), *map(self.words.__getitem__, words[1:])]))
        return out

    def _matches(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(t) for t in texts]
        new = [*{x for matches in split for x in matches if x not in self.known}]
        self.known.update(zip(new, self._encoded(new), strict=True))
        self.chars += sum(map(len, new))
        return [b"".join(map(self.known.__getitem__, matches)) for matches in split]

    def _encoded(self, matches: list[str]) -> list[bytes]:
        """Ids of matches: a match that is a token is that token, the others go through the model as byte characters."""
        out = [self.tokens.get(x.encode()) for x in matches]
        hard = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(hard, self.model.encode([self._pieces(matches[k]) for k in hard], num_threads=1), strict=True):
            out[k] = array("I", ids).tobytes()
        return out

    def _pieces(self, match: str) -> str:
        if match.isascii() and match.isprintable():  # of these bytes only the space has another character
            return match.replace(" ", self.to_chars[0x20])
        return match.encode().decode("latin-1").translate(self.to_chars)


def decode(tokens: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def piece_bytes(model) -> list[bytes]:
    """The bytes of each piece of a serialised vocabulary but the unknown one: the inverse of the byte characters."""
    back = {c: b for b, c in enumerate(byte_characters())}
    return [bytes(back[c] for c in model.id_to_piece(i)) for i in range(len(model)) if i != model.unk_id()]


def _blocks(sizes: np.ndarray) -> Iterator[int]:
    """Numbers of rows that follow each other and hold about BLOCK_BYTES."""
    n = total = 0
    for size in sizes.tolist():
        n, total = n + 1, total + size
        if total > BLOCK_BYTES:
            yield n
            n = total = 0
    if n:
        yield n


def encode_documents(docs: DataFrame, *, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", drop_text: bool = False, digests: bool = False) -> DataFrame:
    """All columns (without the text, if so asked) and a column `ids` array<int> of token ids of the whole text, without special tokens.

    digests: also n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes that the
    ids decode to), in the same pass. A null text counts as empty; an empty text has no ids; rows are independent, so ties, repeated
    rows and ids in other columns don't matter; a text of any length is encoded whole; an empty table stays empty. Input columns of the
    new names are replaced. Any pattern that matches all of a text will do; SPACED_PATTERN is the fastest.
    """
    model = serialise_model(read_ranks(vocabulary))
    made = {ids: T.ArrayType(T.IntegerType(), False)}
    if digests:
        made |= {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    kept = others(docs, *made, *([text] if drop_text else []))
    schema = T.StructType([*docs.select(*kept).schema.fields, *(T.StructField(c, kind) for c, kind in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, pattern)
        back = piece_bytes(codec.model) if digests else []
        for batch in batches:
            column, at = batch.column(len(kept)), 0
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for n in _blocks(sizes):
                encoded = codec.encode([t or "" for t in column.slice(at, n).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in encoded)]).astype(np.int32)
                values = np.frombuffer(b"".join(encoded), dtype=np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
                if digests:
                    decoded = (hashlib.sha256(decode(back, np.frombuffer(x, "<u4"))).hexdigest() for x in encoded)
                    columns += [pa.array(np.diff(ends).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()), pa.array([*decoded], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, n).columns[: len(kept)], *columns], names=[*kept, *made])
                at += n

    return docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), F.col(text).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, *, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns and `decoded` binary, the bytes of the ids. Null ids decode to no bytes. Replaces a column of that name."""
    tokens = inverse_pieces(vocabulary)
    kept = others(encoded, decoded)
    schema = T.StructType([*encoded.select(*kept).schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(kept.index(ids))
            out = [b"" if x.values is None else decode(tokens, x.values.to_numpy()) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*kept, decoded])

    return encoded.select(*kept).mapInArrow(run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_documents(docs, vocabulary=vocabulary, pattern=public_tokenizers.PATTERN, drop_text=True, digests=True)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
