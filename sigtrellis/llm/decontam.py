"""Benchmark decontamination with Aho-Corasick automata over normalised item windows.

Texts are normalised alike on both sides: A-Z lower-cased, then words of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ten consecutive words of
an item, or the whole item if it has fewer. The scan works on UTF-8 bytes, since
every byte of a multi-byte character belongs to a word; hits are mapped back to
code points of the original text.

Benchmarks are cut into automata of at most ``max_windows`` windows. One
automaton is the usual case and needs a single scan; more are run one after the
other over a checkpointed table, so a worker never holds more than one.

Null text has no words. Items that are null or without words give no window.
Repeated rows of documents give repeated rows; repeated item ids count once. Without
items nothing is hit, and an empty table of documents gives an empty result. Extra
columns stay as they are, but for one called ``leak``, which ``find`` replaces.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrellis.llm.session import checkpoint_dir, short_batches

WINDOW = 10
MAX_WINDOWS = 400_000
#: Lower-cases A-Z and turns every byte outside words into a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_RESULT = "struct<n_words:bigint,hits:binary,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>"
#: A worker's automaton, by the number of the part it was built from.
_AUTOMATA: dict[str, object] = {}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


def windows(items: Iterator[tuple[object, str | None]], size: int = WINDOW) -> dict[str, tuple[int, frozenset[str]]]:
    """Each window as it reads between spaces, with its number of words and the items that hold it."""
    found: dict[str, set[str]] = defaultdict(set)
    length: dict[str, int] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            piece = w[i : i + size]
            key = f" {b' '.join(piece).decode('latin-1')} "
            found[key].add(str(item))
            length[key] = len(piece)
    return {k: (length[k], frozenset(v)) for k, v in found.items()}


def automaton(found: dict[str, tuple[int, frozenset[str]]]):
    """Built from windows; None if there are none."""
    import ahocorasick

    if not found:
        return None
    a = ahocorasick.Automaton()
    for key, what in found.items():
        a.add_word(key, what)
    a.make_automaton()
    return a


def scan(a, text: str | None) -> tuple[int, bytearray | None, set[str]]:
    """Number of words, a flag for each word if any is hit, and the items found."""
    w = words(text)
    if a is None or not w:
        return len(w), None, set()
    flags, items, at, word = None, set(), 0, 0
    ends = None
    for end, (n, who) in a.iter(f" {b' '.join(w).decode('latin-1')} "):
        if flags is None:
            flags, ends = bytearray(len(w)), {}
            for i, x in enumerate(w):
                at += len(x) + 1
                ends[at] = i
        word = ends[end]
        flags[word - n + 1 : word + 1] = b"\x01" * n
        items |= who
    return len(w), flags, items


def spans(text: str, flags: bytes) -> list[tuple[int, int]]:
    """Code-point ranges of the original text that runs of hit words cover."""
    raw, out, last = text.encode("utf-8"), [], -2
    for i, m in enumerate(_WORD.finditer(raw)):
        if flags[i]:
            if last == i - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = i
    return [(len(raw[:a].decode("utf-8", "ignore")), len(raw[:b].decode("utf-8", "ignore"))) for a, b in out]


def _parts(benchmark: DataFrame, item_col: str, text_col: str, size: int, max_windows: int) -> Iterator[dict]:
    """The benchmark's windows in parts that one automaton holds; reads item by item, never the table at once."""
    part: dict[str, tuple[int, frozenset[str]]] = {}
    for row in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        for k, (n, who) in windows(iter([(row[0], row[1])]), size).items():
            part[k] = (n, part[k][1] | who if k in part else who)
        if len(part) >= max_windows:
            yield part
            part = {}
    if part:
        yield part


def matcher(spark: SparkSession, part: dict):
    """A Pandas UDF from text to what one automaton finds in it."""
    shared, key = spark.sparkContext.broadcast(part), uuid.uuid4().hex

    @F.pandas_udf(_RESULT)
    def find(text: pd.Series) -> pd.DataFrame:
        if key not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[key] = automaton(shared.value)
        rows = []
        for t in text:
            n, flags, items = scan(_AUTOMATA[key], t)
            rows.append((n, bytes(flags) if flags else None, sum(flags) if flags else 0, sorted(items), [{"start": a, "end": b} for a, b in spans(t, flags)] if flags else []))
        return pd.DataFrame(rows, columns=["n_words", "hits", "n_hit", "items", "spans"])

    return find


def joiner():
    """A Pandas UDF that joins the flags of two automata over the same text."""

    @F.pandas_udf("struct<hits:binary,n_hit:bigint,spans:array<struct<start:int,end:int>>>")
    def join(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for t, x, y in zip(text, a, b):
            flags = bytes(p | q for p, q in zip(x, y)) if x is not None and y is not None else x if y is None else y
            rows.append((flags, sum(flags) if flags else 0, [{"start": i, "end": j} for i, j in spans(t, flags)] if flags else []))
        return pd.DataFrame(rows, columns=["hits", "n_hit", "spans"])

    return join


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with one more column ``leak``: struct of n_words, hits, n_hit, items, spans.

    Any column of docs called ``leak`` is replaced.
    """
    spark = docs.sparkSession
    short_batches(spark)
    parts = _parts(benchmark, item_col, item_text_col, window, max_windows)
    out = docs.withColumn("leak", matcher(spark, next(parts, {}))(F.col(text_col).cast("string")))
    for part in parts:
        checkpoint_dir(spark)
        out = out.checkpoint(eager=True)
        new = matcher(spark, part)(F.col(text_col).cast("string"))
        both = joiner()(F.col(text_col).cast("string"), F.col("leak.hits"), new["hits"])
        out = out.withColumn("leak", F.struct(F.col("leak.n_words").alias("n_words"), both["hits"].alias("hits"), both["n_hit"].alias("n_hit"), F.array_sort(F.array_union("leak.items", new["items"])).alias("items"), both["spans"].alias("spans")))
    return out


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = find(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), **options)
    ids = F.concat_ws(",", F.sort_array("leak.items"))
    return found.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        F.col("leak.n_hit").alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.size("leak.items") > 0).alias("contaminated"),
        F.col("leak.spans").alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with their columns as they were."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))
    return find(packed, benchmark.select("item_id", "text")).where(F.size("leak.items") == 0).select(*[F.col(f"row.`{c}`") for c in names])
