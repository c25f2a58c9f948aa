"""Operator 2: secret scans by dictionary-primed compression novelty."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("assign", "access", "hex", "novel")  # in the order in which spans at one start are listed

# Fixed patterns of the base scan. A run of 24 or more is the run of any length kept only from 24 on.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_CANDIDATE = re.compile(r"[A-Za-z0-9+/=~-](?:[A-Za-z0-9+/_.=~-]{14,})[A-Za-z0-9+/_=~-]")
_SENSITIVE = re.compile(r"key|token|secret|passw|pwd|credential|auth|bearer|private|signature|cookie|session", re.I | re.A)
_IDENTIFIER = re.compile(r"[A-Za-z_]{4,32}")
_CHUNK = re.compile(r"[A-Za-z0-9]{12,}")
_CLASSES = re.compile(r"[a-z]+|[A-Z]+|[0-9]+")
DICTIONARY_WORDS = 2_000  # bound on the corpus' identifiers in the dictionary

# Identifiers and words that code and configuration repeat: text like them is no news to the compressor.
IDENTIFIERS = """
public private static void return function class import export default const string boolean integer float double
self this null none true false undefined request response session context controller service manager handler factory
repository configuration connection database username password secret token api_key access_key client_id client_secret
authorization bearer credential certificate private_key public_key signature algorithm encrypt decrypt encode decode
authentication application component interface implementation abstract exception message callback promise async await
listener https http www com org net html json yaml xml index main test example localhost content-type user-agent
""".strip()


def identifiers(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS) -> str:
    """The words and identifiers that stand in the most texts that hold a sensitive word, the most frequent last; at least two texts each.

    Counted over all texts, summed up within batches first; at most ``most`` reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[str] = Counter()
            for text in b.column(0):
                text = text.as_py() or ""
                if _SENSITIVE.search(text):
                    n.update(set(_IDENTIFIER.findall(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    words = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()
    return " ".join(r["word"] for r in reversed(top))


@lru_cache(maxsize=2)
def _compressor(words: str = ""):
    import zstandard

    primer = zstandard.ZstdCompressionDict(f"{words} {IDENTIFIERS}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primer.precompute_compress(level=3)
    return zstandard.ZstdCompressor(dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(before: str, candidate: str, after: str = "", words: str = "") -> float:
    """Bytes that the candidate adds to its surroundings once compressed, per byte of its own; the identifier dictionaries prime both."""
    z, around = _compressor(words), f"{before}\n{after}\n"
    return (len(z.compress((around + candidate).encode())) - len(z.compress(around.encode()))) / max(1, len(candidate.encode()))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base scan, in code points."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def _mixed(candidate: str) -> bool:
    """Whether some run of letters and digits in it changes between capitals, small letters and digits at least three times.

    Dates, paths, file names and prose are made of shorter or plainer runs.
    """
    return any(len(_CLASSES.findall(c)) > 3 for c in _CHUNK.findall(candidate))


def novel_spans(text: str, base: list[tuple[int, int, int]], context: int = 256, near: int = 48, threshold: float = 0.62, words: str = "") -> list[tuple[int, int, int]]:
    """Strings outside the base spans that stand near a sensitive word, on either side, and that their surroundings don't help to compress."""
    if not _SENSITIVE.search(text):
        return []
    out, i, reached = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        while i < len(base) and base[i][0] < e:  # candidates and base spans both ascend
            reached = max(reached, base[i][2])
            i += 1
        if reached > s or not _mixed(m.group()):
            continue
        if not (_SENSITIVE.search(text, max(0, s - near), s) or _SENSITIVE.search(text, e, e + near)):
            continue
        if novelty(text[max(0, s - context) : s], m.group(), text[e : e + context], words) >= threshold:
            out.append((s, 3, e))
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = 256, near: int = 48, threshold: float = 0.62) -> DataFrame:
    """Rows (id, n_assign, n_access, n_hex, n_novel, base, spans) for every document; base and spans hold kind:start:end.

    The dictionary that primes the compressor holds fixed identifiers and those that the corpus repeats most.
    Null text counts as empty: no spans. Spans of one start are listed in the order of KINDS. ``threshold`` is the
    share of a candidate's bytes that must remain news beside ``context`` characters on either side. Repeated rows give
    repeated rows; other columns are not read; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    handle = docs.sparkSession.sparkContext.broadcast(identifiers(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = handle.value
        for b in batches:
            rows = []
            for text in b.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = novel_spans(text, base, context, near, threshold, words)
                rows.append((*(sum(k == j for _, k, _ in base) for j in range(3)), len(more), _written(base), _written(sorted(base + more))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, "n_assign", "n_access", "n_hex", "n_novel", "base", "spans"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, n_novel long, base string, spans string")


def redact(text: str, spans: str, mask: str = "[SECRET]") -> str:
    """The text with the spans' union masked."""
    at, out = 0, []
    for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
