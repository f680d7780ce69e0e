"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes (``common.steps``), not by rows. A text above ``split_bytes`` is cut at safe
boundaries, so that the sum of the parts' lengths is the whole text's length.

Safe boundaries: no piece of the vocabulary holds a space mark after another character, so no merge crosses from a
character to a space after it. The library puts one space mark before a text; a part that starts with a space gives
it back by dropping that space. No piece holds a newline, so a part may start at one too: the mark before it is then
one token of its own, taken off. ``Counter`` checks both facts in the vocabulary and does not cut where they fail.

Null and empty texts have 0 tokens. Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_text

SCHEMA = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


class Counter:
    def __init__(self, path: str, split_bytes: int = 1 << 20):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        self.space_safe = not any("▁" in p.lstrip("▁") for p in plain)
        self.line_safe = not any("\n" in p for p in plain) and self.sp.encode("\n a", out_type=str)[:1] == ["▁"]
        self.split = split_bytes
        # a space that follows and precedes visible text, or a newline after visible text
        marks = [r"(?<=[^ ▁\n]) (?=[^ ▁\n])"] * self.space_safe + [r"(?<=[^ ▁\n])\n(?=[^ ▁\n])"] * self.line_safe
        self.cut = re.compile("|".join(marks)) if marks else None

    def parts(self, text: str) -> list[tuple[str, int]]:
        """Parts to encode and what to take off each length."""
        if len(text) <= self.split or self.cut is None:
            return [(text, 0)]
        out, start = [], 0
        while start < len(text):
            m = self.cut.search(text, start + self.split) if start + self.split < len(text) else None
            end = m.start() if m else len(text)
            part = text[start:end]
            if start and part[0] == " ":
                out.append((part[1:], 0))
            else:
                out.append((part, int(start > 0)))
            start = end
        return out

    def __call__(self, texts: list[bytes]) -> list[list[int]]:
        cut = [self.parts(t.decode("utf-8", "replace")) for t in texts]
        flat = [p for parts in cut for p, _ in parts]
        lengths = iter([len(x) for x in self.sp.encode(flat, num_threads=1)] if flat else [])
        return [[len(t) for t in texts], [sum(next(lengths) - off for _, off in parts) for parts in cut]]


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, split_bytes: int = 1 << 20) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row."""
    out = per_text(df, id_col, text_col, SCHEMA, lambda: Counter(model_path, split_bytes))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
