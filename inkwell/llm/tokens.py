"""Operator 3: exact token counts, with overlap resynchronisation for huge documents."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

BATCH_CHARS = 2_000_000  # of text encoded at once, which bounds a worker's memory


@lru_cache(maxsize=2)
def load(path: str):
    """The library's own encoder without truncation or padding; special strings in texts keep its default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


_OTHER = re.compile("[^\x00-\u024f]")  # beyond Latin, letter classes hang on each engine's Unicode version


def count_library(tok, texts: list[str]) -> list[int]:
    if hasattr(tok, "encode_batch_fast"):
        return [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return [len(x) for x in tok.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def _merger(path: str):
    """The same byte-level vocabulary as merge ranks, for an engine about four times as fast; None for other kinds.

    Byte-level vocabularies number their tokens in the order of the merges, so ids are ranks. The vocabulary writes
    each byte as a printable character: itself where printable, else the next one from U+0100 on.
    """
    if not splices(path):
        return None
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    tok = load(path)
    added = {t.content for t in tok.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in tok.get_vocab().items() if t not in added}
    # fixed value: how the library's byte-level pre-tokenizer cuts
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), added


def count_whole(tok, path: str, texts: list[str]) -> list[int]:
    """Counts of whole texts; those with an added token's string or letters beyond Latin go to the library itself."""
    if (fast := _merger(path)) is None:
        return count_library(tok, texts)
    enc, added = fast
    slow = [any(s in t for s in added) or bool(_OTHER.search(t)) for t in texts]
    rest = iter(count_library(tok, [t for t, x in zip(texts, slow, strict=True) if x]))
    return [next(rest) if x else len(enc.encode_ordinary(t)) for t, x in zip(texts, slow, strict=True)]


@lru_cache(maxsize=2)
def splices(path: str) -> bool:
    """Whether the file's tokenizer is byte-level with the pre-tokenizer that always cuts at seams, without a normalizer."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    return cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")


def _seams(text: str, lo: int, hi: int) -> Iterator[int]:
    """Places in (lo, hi) where every byte-level pre-tokenizer cuts whatever stands around: a space between two
    characters that are no white space. No piece goes on past such a space and none looks behind it."""
    at = text.find(" ", lo + 1, hi)
    while at > 0:
        if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
            yield at
        at = text.find(" ", at + 1, hi)


def _encoded(tok, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Places of the tokens of text[start:end]."""
    return [(start + s, start + e) for s, e in tok.encode(text[start:end], add_special_tokens=False).offsets]


def _clean(spans: list[tuple[int, int]], at: int) -> bool:
    return not any(s < at < e for s, e in spans)


def _common(here: list[tuple[int, int]], ahead: list[tuple[int, int]], seams: list[int]) -> int | None:
    """The first seam past a third of the overlap where neither side has a token across and from where both agree up to the next seam."""
    for a, b in zip(seams[len(seams) // 3 :], seams[len(seams) // 3 + 1 :], strict=False):
        if [x for x in here if a <= x[0] and x[1] <= b] == [x for x in ahead if a <= x[0] and x[1] <= b] and all(_clean(s, p) for s in (here, ahead) for p in (a, b)):
            return a
    return None


def count_spliced(tok, path: str, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a long text from chunks that overlap.

    Each chunk is encoded once, with offsets. Two chunks are spliced at a seam of their overlap from where both have the
    same tokens: the first one's count up to there, the second one's from there on. Without such a seam the overlap is
    doubled; where it reaches what is counted already, the chunk itself is.
    """
    total = counted = left = 0
    size = chunk
    end = min(size, len(text))
    here = _encoded(tok, text, left, end)
    while end < len(text):
        wide, found, start = overlap, None, 0
        while end - wide > counted:
            start = end - wide
            ahead = _encoded(tok, text, start, min(start + max(size, 2 * wide), len(text)))
            seams = list(_seams(text, start, end))
            near = [x for x in here if x[1] > start]
            if (found := _common(near, [x for x in ahead if x[0] < end], seams)) is not None:
                break
            wide *= 2
        if found is None:
            size *= 2  # no seam in the whole chunk: take more at once
            end = min(left + size, len(text))
            here = _encoded(tok, text, left, end)
            continue
        total += sum(counted <= s and e <= found for s, e in here)
        here, end = ahead, min(start + max(size, 2 * wide), len(text))
        left, counted, size = start, found, chunk
    return total + sum(s >= counted for s, _ in here)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) for every document.

    Null text counts as empty: 0 bytes, 0 tokens. Texts longer than ``chunk`` characters are encoded in overlapping
    chunks (.json tokenizers that cut at spaces), all others whole; both give the library's own count. Repeated rows
    give repeated rows; other columns are not read; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            counts, part, held = [0] * len(texts), [], 0
            for i, t in enumerate(texts):
                if not t:
                    continue
                if splices(path) and len(t) > chunk:
                    counts[i] = count_spliced(tok, path, t, chunk, overlap)
                    continue
                part.append(i)
                held += len(t)
                if held >= BATCH_CHARS:
                    for j, n in zip(part, count_whole(tok, path, [texts[j] for j in part]), strict=True):
                        counts[j] = n
                    part, held = [], 0
            if part:
                for j, n in zip(part, count_whole(tok, path, [texts[j] for j in part]), strict=True):
                    counts[j] = n
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
