"""Problem 8: token ids of every document with a public tokenizer.

Texts up to ``leaf_chars`` are encoded directly.  Longer texts are cut into leaves that are encoded in parallel tasks;
the leaves are then joined pairwise, tree-wise: a window around each join (at first the last pre-token of the left part
and the first of the right part) is encoded again and grown until its pre-tokens meet both sides at a boundary, from
where both sides agree exactly.  A pre-token that is itself long (a run without a break) is encoded by halves in the same
way: a window of ids around the join is encoded again and grown until its first id is the left half's and its last the
right half's.  As ids are a valid encoding exactly if all neighbours are, the joined ids are those of the whole.

The leaves of one document meet in one task, so a document's text and ids must fit its memory.  Encoding a pre-token by
itself uses a function of the tokenizer library that is not public (tiktoken 0.x); without it the encoder does not start.

Null and empty texts have the empty list of ids.  Extra columns are ignored, repeated rows give repeated rows.
"""

from __future__ import annotations

import ast
import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.session import spread, table

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
LEAF_CHARS = 1 << 16
#: Pre-tokens of more bytes are encoded by halves.
LONG_PIECE, LEAF_PIECE = 1024, 256
_ENCODERS: dict = {}


def shipped_pattern(path: str) -> str:
    """The pre-token pattern beside the vocabulary: the string that the file assigns to PATTERN, read but not run."""
    with open(path, encoding="utf-8") as f:
        for node in ast.parse(f.read()).body:
            if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "PATTERN" for t in node.targets):
                return ast.literal_eval(node.value)
    raise ValueError(f"no PATTERN in {path}")


class Encoder:
    """byte-level BPE from a rank file; ``pieces`` are the pre-tokens within which merges happen."""

    def __init__(self, directory: str, name: str):
        import regex
        import tiktoken

        pattern = shipped_pattern(os.path.join(directory, "__init__.py"))
        with open(os.path.join(directory, name + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.regex = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        if not hasattr(self.bpe, "_encode_single_piece"):
            raise RuntimeError(f"tiktoken {tiktoken.__version__} cannot encode a single pre-token")

    def ids(self, text: str) -> list[int]:
        text = _clean(text)
        if len(text) <= LONG_PIECE // 4 or not _RUN.search(text):
            return self.bpe.encode_ordinary(text)
        return [i for m in self.regex.finditer(text) for i in self.piece(m.group().encode())]

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token, by halves where it is long."""
        if len(raw) <= LONG_PIECE:
            return self.bpe._encode_single_piece(raw)
        parts = [(raw[i : i + LEAF_PIECE], self.bpe._encode_single_piece(raw[i : i + LEAF_PIECE])) for i in range(0, len(raw), LEAF_PIECE)]
        while len(parts) > 1:
            parts = [self._meet(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][1]

    def _meet(self, left: tuple[bytes, list[int]], right: tuple[bytes, list[int]]) -> tuple[bytes, list[int]]:
        (a, x), (b, y) = left, right
        n = 4
        while True:
            tail, head = x[-n:], y[:n]
            got = self.bpe._encode_single_piece(self.bpe.decode_bytes(tail) + self.bpe.decode_bytes(head))
            if (len(tail) == len(x) or got[0] == tail[0]) and (len(head) == len(y) or got[-1] == head[-1]):
                return a + b, x[: len(x) - len(tail)] + got + y[len(head) :]
            n *= 2

    def pieces(self, text: str, end: int) -> list[int]:
        """Ids of the pre-tokens of ``text`` that lie before ``end``, a boundary; what follows is seen as lookahead."""
        out: list[int] = []
        for m in self.regex.finditer(text):
            if m.start() >= end:
                break
            out += self.piece(m.group().encode())
        return out

    def starts(self, text: str) -> np.ndarray:
        return np.fromiter((m.start() for m in self.regex.finditer(text)), dtype=np.int64)


_RUN = re.compile(r"[^\s]{256}|\s{256}")


def _clean(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def encoder(directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> Encoder:
    if (directory, name) not in _ENCODERS:
        _ENCODERS[directory, name] = Encoder(directory, name)
    return _ENCODERS[directory, name]


def join(enc: Encoder, left: tuple, right: tuple) -> tuple:
    """Encoding of the concatenation of two encoded texts, encoding only a window around the join again.

    A pre-token depends on its own start and on at most one character after its end, so all pre-tokens of the left part
    but its last stand.  The window starts there and grows to the right until a pre-token boundary of the joined text is
    one of the right part too; from there on the right part's ids stand.
    """
    (a, ids_a), (b, ids_b) = left, right
    if not a or not b:
        return (b, ids_b) if not a else (a, ids_a)
    tail = 64
    while True:  # start of the last pre-token of the left part, found from a suffix that meets the full scan
        at = max(0, len(a) - tail)
        starts = enc.starts(a[at:]) + at
        # from the second boundary on, a scan begun inside a pre-token agrees with the full scan at white space
        safe = [s for s in starts[1:] if a[s - 1 : s] and not a[s - 1].isspace() and a[s].isspace()] if at else [0]
        if safe or at == 0:
            begin = safe[-1] if safe else 0
            break
        tail *= 4
    size = 64
    while True:
        head = b[:size]
        joined = set((enc.starts(a[begin:] + head) + begin - len(a)).tolist())
        alone = enc.starts(head)
        last = len(b) <= size
        meet = [s for s in alone.tolist() if s in joined and (last or s < int(alone[-1]))]
        if meet or last:
            cut = meet[0] if meet else len(b)
            break
        size *= 4
    window = a[begin:] + b[:size]
    old_tail, old_head = enc.ids(a[begin:]), enc.pieces(b[:size], cut)
    keep = ids_a[: len(ids_a) - len(old_tail)]
    return a + b, keep + enc.pieces(window, len(a) - begin + cut) + ids_b[len(old_head) :]


def tree(enc: Encoder, parts: list[tuple]) -> list[int]:
    while len(parts) > 1:
        parts = [join(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0][1] if parts else []


def encode(documents: DataFrame, directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids of every row of ``documents`` (doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))  # ids as text: a null would make them floats

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(directory, name)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [enc.ids(t) for t in b["text"]]})

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(directory, name)
        for b in batches:
            yield b.assign(ids=[enc.ids(t) for t in b["part"]])

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k")
        ids = tree(encoder(directory, name), [(t, list(i)) for t, i in zip(g["part"], g["ids"])])
        return pd.DataFrame({"doc_id": g["doc_id"][:1], "ids": [ids]})

    near = spread(docs.where(F.length("text") <= leaf_chars)).mapInPandas(short, "doc_id string, ids array<int>")
    n = F.ceil(F.length("text") / leaf_chars).cast("int")
    far = (
        docs.where(F.length("text") > leaf_chars)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
        .select("doc_id", "row", "k", F.substring("text", F.col("k") * leaf_chars + 1, F.lit(leaf_chars)).alias("part"))
        .repartition("row", "k")
        .mapInPandas(leaves, "doc_id string, row bigint, k int, part string, ids array<int>")
        .groupBy("row")
        .applyInPandas(joined, "doc_id string, ids array<int>")
    )
    return near.unionByName(far).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
