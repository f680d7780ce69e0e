"""Byte-level BPE encoding and decoding, with tree concatenation for long unsplit text.

Text is split as the library does, first at special tokens, then by its pre-tokenizer. Short pieces are encoded by
the library and kept in a cache. A piece above ``leaf`` characters is cut in halves down to leaves, which the library
encodes in one parallel batch; at each join of two halves a window of tokens on both sides is decoded and encoded
anew, and doubled until its first token equals the left side's and its last token the right side's. Neighbouring
tokens of a BPE result stay neighbours in any longer text, so agreement at both edges makes the joined ids exact.

The split and the byte alphabet are those of the plain byte-level BPE; a file that asks for more (a normalizer, a prefix
space, another split or model, added tokens that strip) raises an error.

Null texts count as empty and give no ids; repeated rows give repeated results; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import per_text, small_batches, tidied

# The byte-level pre-tokenizer's pattern for code points up to U+024F without the rarer white space.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\x09-\x0d\x20"
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Text with other characters goes through the library's own splitter.
RARE = re.compile("[\x1c-\x1f\x85\xa0ɐ-\U0010ffff]")
#: Pieces that stay pieces between newlines: no white space but one space in front.
APART = re.compile(f" ?[^{SPACE}\x1c-\x1f\x85\xa0ɐ-\U0010ffff]+")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def check(spec: dict) -> None:
    """Raises for a tokenizer file that this module would not encode as the library does: see the docstring above."""
    split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    marks = ("single_word", "lstrip", "rstrip", "normalized")
    wrong = [
        (spec.get("normalizer") is not None, "a normalizer"),
        (split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True), "another split than the plain byte-level one"),
        (model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")), "another model than plain BPE"),
        (any(a.get(k) for a in spec["added_tokens"] for k in marks), "added tokens with rules of their own"),
    ]
    if found := [why for bad, why in wrong if bad]:
        raise ValueError(f"unsupported tokenizer file: {', '.join(found)}")


class Codec:
    def __init__(self, path: str, leaf: int = 256, cache: int = 300_000):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.leaf, self.most, self.cache = leaf, cache, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        newline = self.library(["\n"])[0]
        self.newline = newline[0] if len(newline) == 1 else None
        byte = byte_alphabet()
        self.bytes = [b""] * self.t.get_vocab_size(with_added_tokens=True)
        for token, i in self.t.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(byte[c] for c in token)

    def library(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch(pieces, add_special_tokens=False)]

    def apart(self, pieces: list[str], at_once: int = 5000) -> list[bytes]:
        """ids of APART pieces, encoded as one text with newlines between them: a call for each piece costs far more."""
        out: list[bytes] = []
        for i in range(0, len(pieces), at_once):
            some = pieces[i : i + at_once]
            ids = np.array(self.t.encode("\n".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.newline)
            if len(cuts) != len(some) - 1:
                raise ValueError("a piece holds a newline")
            raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
            out += [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends)]
        return out

    def pieces(self, text: str) -> list[str]:
        if not RARE.search(text):
            return PLAIN.findall(text)
        return [text[a:b] for _, (a, b) in self.t.pre_tokenizer.pre_tokenize_str(text)]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """ids of the concatenation of two neighbouring parts of one piece."""
        if not left or not right:
            return left + right
        w = 4
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            while a and self.bytes[left[a]][0] & 0xC0 == 0x80:  # start on a character
                a -= 1
            while b < len(right) and self.bytes[right[b]][0] & 0xC0 == 0x80:
                b += 1
            raw = b"".join(self.bytes[i] for i in [*left[a:], *right[:b]])
            ids = self.library([raw.decode("utf-8")])[0]
            if (a == 0 or ids[0] == left[a]) and (b == len(right) or ids[-1] == right[b - 1]):
                return left[:a] + ids + right[b:]
            w *= 2

    def tree(self, piece: str) -> list[int]:
        """ids of a long piece: all leaves at once, then joins of neighbours until one part is left."""
        parts = self.library([piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)])
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        split: list[list] = []
        missing: set[str] = set()
        known = self.cache
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            parts = self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]
            pieces = [x for i, part in enumerate(parts) for x in ([part] if i % 2 else self.pieces(part))]
            missing.update(filterfalse(known.__contains__, pieces))
            split.append(pieces)
        put = lambda ids: np.array(ids, "<u4").tobytes()
        for s in missing & self.special.keys():
            known[s] = put([self.special[s]])
            missing.discard(s)
        short = [x for x in missing if len(x) <= self.leaf]
        alone = [x for x in short if self.newline is None or not APART.fullmatch(x)]
        apart = list(set(short).difference(alone))
        known.update(zip(apart, self.apart(apart)))
        known.update(zip(alone, map(put, self.library(alone))) if alone else ())
        long = {x: put(self.tree(x)) for x in missing if len(x) > self.leaf}  # not kept: they rarely return
        get = (known | long).__getitem__ if long else known.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in split]
        if len(known) > self.most:  # what this call used stays, frequent pieces with it
            self.cache = {x: known[x] for x in set().union(*split) if x in known}
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 256) -> DataFrame:
    """id, n_tokens, ids (array of int)."""
    out = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def make():
        codec = Codec(path, leaf)

        def f(texts):
            raw = codec.encode(texts)
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32())
            return [pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]

        return f

    return per_text(df, id_col, text_col, out, make)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text of an ``ids`` array column; null ids give an empty text."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    small_batches(df.sparkSession)
    return df.select(id_col, ids_col).mapInArrow(tidied(run), schema)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 256) -> DataFrame:
    """id, n_tokens and SHA-256 of the ids and of the text that they decode to, in one pass without moving the ids."""
    out = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def make():
        codec = Codec(path, leaf)

        def f(texts):
            raw = codec.encode(texts)
            return [[len(x) // 4 for x in raw], [_sha(x) for x in raw], [_sha(codec.decode(x).encode()) for x in raw]]

        return f

    return per_text(df, id_col, text_col, out, make)
