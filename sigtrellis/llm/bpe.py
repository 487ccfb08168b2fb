"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Each match of the pattern is one word; a word that is a piece of the vocabulary is one
token, any other is folded: its bytes start as single tokens, and each step joins the
leftmost pair of least rank, until no neighbouring pair has a rank. The rank map is a
literal: the sparse table of the one pair that each piece is joined from, its rows moved
into each other, so that two look-ups give a cost. When it is built, every piece is shown to come from
exactly one pair, of lower ranks than its own. Joining a pair therefore never makes a
better one, and words of more than ``LONG`` bytes join all pairs of one rank at a time,
from the left, as one replacement in a string; they take as many passes as they have
ranks to join.

The distinct words of one text in ``COUNT_OF`` (by a hash of the text) are counted, and those of the largest counts, at
most ``remembered``, are folded once each; executors get their ids as a dictionary of
that bounded size. A text is cut into runs of their ids and the words that aren't
among them, as byte arrays, which are folded once for each text that holds them. The
dictionary changes speed only, never ids: every text is cut and encoded whole.

Decoding looks the pieces up in a literal array, joins them and restores bytes.

Null or empty text has no ids and decodes to no bytes. Repeated rows stay repeated. An
empty table gives an empty result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrellis.llm.session import drop, short_batches, table

#: Words encoded in advance, at most; each is at most LONGEST_WORD characters.
REMEMBERED = 300_000
LONGEST_WORD = 40
#: Words are counted in one text of so many.
COUNT_OF = 4
#: Distinct words that a worker counts before it passes them on.
COUNTED = 100_000
#: Texts that a worker cuts at a time.
AT_ONCE = 256
#: Words of more bytes are folded by replacements.
LONG = 48
#: Unicode white space, which the pattern's \s means.
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def spelled_out(pattern: str) -> str:
    """The same pattern with \\s and \\S as the white space of Unicode, whatever a library takes them for."""
    inside = re.sub(r"\[\^([^\]]*)\\s([^\]]*)\]", lambda m: f"[^{m[1]}{_SPACE}{m[2]}]", pattern)
    return inside.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


@functools.lru_cache(maxsize=4)
def finder(pattern: str) -> Callable[[str], list[str]]:
    """All matches in a text, as the regex library finds them.

    Where the pattern has nothing but \\p{L}, \\p{N} and white space that the standard library lacks, that one
    finds them in texts without characters beyond U+FFFF, with these classes spelled out; it is faster.
    """
    slow = regex.compile(spelled_out(pattern)).findall
    if not re.fullmatch(r"(?:\\p\{[LN]\}|\\[sS]|\(\?!|[^\\(])*", pattern) or re.search(r"\[\^?\]", pattern):
        return slow
    every = "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)
    spelled = re.split(r"(\[[^\]]*\])", spelled_out(pattern))  # classes at odd places
    for name in (r"\p{L}", r"\p{N}"):
        ranges = "".join(f"\\u{ord(m[0]):04x}-\\u{ord(m[-1]):04x}" for m in regex.findall(f"{name}+", every))
        spelled = [x.replace(name, ranges if i % 2 else f"[{ranges}]") for i, x in enumerate(spelled)]
    fast, far = re.compile("".join(spelled)).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: slow(text) if far(text) else fast(text)


def ranks(path: str) -> list[str]:
    """The pieces of a rank file by rank, as ISO-8859-1 strings."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    found = {int(r): base64.b64decode(p).decode("latin-1") for p, r in pairs}
    return [found[i] for i in range(len(found))]


def pairs(pieces: list[str]) -> dict[int, tuple[int, int]]:
    """The one pair of lower ranks that merges make each longer piece from."""
    rank = {p: i for i, p in enumerate(pieces)}
    out = {}
    if len(pieces) > 65_536:
        raise ValueError("the vocabulary is too large for 16 bits")
    for i, piece in enumerate(pieces):
        parts = list(piece)
        while len(parts) > 2:
            costs = [rank.get(x + y, i) for x, y in zip(parts, parts[1:])]
            at = min(range(len(costs)), key=costs.__getitem__)
            if costs[at] >= i:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) > 1:
            made = tuple(rank[x] for x in parts)
            if len(made) != 2 or max(made) >= i:
                raise ValueError(f"the vocabulary doesn't come from merges: rank {i}")
            out[i] = made
    if any(chr(b) not in rank for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    return out


@functools.lru_cache(maxsize=4)
def _tables(path: str) -> tuple[str, str, str]:
    """Single bytes' ranks, cells and shifts, as decimals with commas.

    The rank of a pair (a, b) is at cells[shifts[b] + a], together with b, since rows of other tokens lie there too.
    """
    pieces = ranks(path)
    rows: dict[int, list[tuple[int, int]]] = {}
    for i, (a, b) in pairs(pieces).items():
        rows.setdefault(b, []).append((a, i))
    free = np.ones(8 * len(pieces), dtype=bool)
    cells, shifts = np.zeros(len(free), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
    start = 0
    for b, row in sorted(rows.items(), key=lambda r: -len(r[1])):
        a = np.array([x for x, _ in row])
        start += int(free[start:].argmax())
        low, most = start, 64
        if len(row) == 1:
            most = 1
        while True:  # to the first place where every cell of the row is free
            places = low + np.flatnonzero(free[low : low + most]) - a.min()
            for x in a:
                places = places[free[places + x]]
            if len(places):
                break
            low, most = low + most, 4 * most
            if low > 4 * len(pieces):
                raise ValueError("the table of pairs has no room")
        shifts[b] = places[0]
        free[shifts[b] + a] = False
        cells[shifts[b] + a] = [(b + 1) * 65_536 + i for _, i in row]
    byte = {p: i for i, p in enumerate(pieces) if len(p) == 1}
    used = len(free) - int((~free[::-1]).argmax())
    return ",".join(str(byte[chr(i)]) for i in range(256)), ",".join(map(str, cells[:used])), ",".join(map(str, shifts))


def rank_map(path: str) -> Column:
    """The literal that fold() reads: struct of bytes, cells and shifts."""
    names = (("bytes", "array<int>"), ("cells", "array<bigint>"), ("shifts", "array<int>"))
    return F.struct(*[F.split(F.lit(x), ",").cast(kind).alias(name) for x, (name, kind) in zip(_tables(path), names)])


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cost(rank: Column, a: Column, b: Column) -> Column:
    """The rank of what two tokens join to; if they don't, null or any number from 65,536 on."""
    return F.get(rank["cells"], F.get(rank["shifts"], b) + a).bitwiseXOR((b.cast("long") + 1) * 65_536)


def _costs(rank: Column, ids: Column) -> Column:
    return F.transform(F.slice(ids, F.lit(2), F.size(ids)), lambda b, i: _cost(rank, F.get(ids, i), b))


def _by_steps(ids: Column, rank: Column) -> Column:
    """One pair at a time. The state has one number for each token: the cost of joining it to the next one, then 16 bits of the token."""
    far, bits = F.lit(1 << 34).cast("long"), 65_536

    def cell(a: Column, b: Column) -> Column:
        return F.coalesce(_cost(rank, a, b), far) * bits + a

    def token(x: Column) -> Column:
        return x.bitwiseAND(F.lit(bits - 1).cast("long")).cast("int")

    def step(state: Column, _: Column) -> Column:
        def merge(i: Column) -> Column:
            new = F.shiftright(F.get(state, i - 1), 16).cast("int")
            here = F.when(i + 1 < F.size(state), cell(new, token(F.get(state, i + 1)))).otherwise(far * bits + new)
            two = F.when(i > 1, F.array(cell(token(F.get(state, i - 2)), new), here)).otherwise(F.array(here))
            # flatten() copies arrays several times as fast as concat() does
            return F.when(F.get(state, i - 1) < bits * bits, F.flatten(F.array(F.slice(state, F.lit(1), F.greatest(i - 2, F.lit(0))), two, F.slice(state, i + 2, F.size(state))))).otherwise(state)

        # equal numbers are equal pairs, so the first is the leftmost
        return _let(F.array_position(state, F.array_min(state)).cast("int"), merge)

    start = F.transform(ids, lambda a, i: F.when(i + 1 < F.size(ids), cell(a, F.get(ids, i + 1))).otherwise(far * bits + a))
    return F.aggregate(F.slice(ids, F.lit(2), F.size(ids)), start, step, lambda s: F.transform(s, token))


def _by_ranks(ids: Column, rank: Column) -> Column:
    """All pairs of the least rank at a time, on a string of ,id; for each token."""
    written = F.concat(F.lit(","), F.array_join(ids.cast("array<string>"), ";,"), F.lit(";"))

    def step(state: Column, _: Column) -> Column:
        def pass_(now: Column) -> Column:
            def merge(costs: Column) -> Column:
                def at(i: Column) -> Column:
                    old = F.concat(F.lit(","), F.get(now, i - 1).cast("string"), F.lit(";,"), F.get(now, i).cast("string"), F.lit(";"))
                    new = F.concat(F.lit(","), F.array_min(costs).cast("string"), F.lit(";"))
                    return F.struct(F.replace(state["written"], old, new).alias("written"), F.lit(False).alias("done"))

                done = F.struct(state["written"].alias("written"), F.lit(True).alias("done"))
                return F.when(F.array_min(costs) < 65_536, _let(F.array_position(costs, F.array_min(costs)).cast("int"), at)).otherwise(done)

            return _let(_costs(rank, now), merge)

        return F.when(state["done"], state).otherwise(_let(read(state["written"]), pass_))

    def read(text: Column) -> Column:
        return F.split(F.substr(text, F.lit(2), F.length(text) - 2), ";,").cast("array<int>")

    return F.aggregate(F.sequence(F.lit(1), F.size(ids)), F.struct(written.alias("written"), F.lit(False).alias("done")), step, lambda s: read(s["written"]))


def fold(ids: Column, rank: Column) -> Column:
    """The ids of one word, given the ranks of its bytes, by merges in order of rank."""
    return _let(ids, lambda x: F.when(F.size(x) > LONG, _by_ranks(x, rank)).otherwise(_by_steps(x, rank)))


def _joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


def counts(docs: DataFrame, pattern: str) -> DataFrame:
    """word and n in one text of ``COUNT_OF``, summed by each worker, ``COUNTED`` words at a time, before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, seen = finder(pattern), Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(find(text))
            if len(seen) > COUNTED:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    texts = docs.select(F.col("text").cast("string")).where((F.col("text") != "") & (F.pmod(F.xxhash64("text"), F.lit(COUNT_OF)) == 0))
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Known:
    """Words and their ids: packed as Arrow on the driver and on the way, a dict in a worker that looks something up."""

    def __init__(self, rows: pa.Table | None = None):
        sink = pa.BufferOutputStream()
        rows = pa.table({"word": pa.array([], "string"), "ids": pa.array([], "string")}) if rows is None else rows
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        self.packed, self.size = sink.getvalue().to_pybytes(), rows.num_rows

    @functools.cached_property
    def ids(self) -> dict[str, str]:
        rows = pa.ipc.open_stream(self.packed).read_all()
        return dict(zip(rows["word"].to_pylist(), rows["ids"].to_pylist()))


def dictionary(docs: DataFrame, pattern: str, rank: Column, remembered: int = REMEMBERED) -> Known:
    """The ids of the words with the largest counts, of ``remembered`` at most."""
    counted = table(counts(docs, pattern).where((F.length("word") <= LONGEST_WORD) & (F.col("n") > 1)), "words")
    # counts to three binary digits: a few hundred rows tell from which count on the words fit
    size = F.floor(F.log2("n") * 8)
    total, least = 0, None
    for r in sorted(counted.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        total += r.words
        if total > remembered:
            break
        least = r.size
    if least is None:
        return Known()
    letters = F.split(F.decode(F.col("word").cast("binary"), "ISO-8859-1"), "")
    spread = counted.where(size >= least).select("word").repartition(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    made = table(spread.select("word", _let(rank, lambda r: _joined(fold(F.transform(letters, lambda c: F.get(r["bytes"], F.ascii(c))), r))).alias("ids")), "word-ids")
    found = Known(made.toArrow())
    drop(counted, made)
    return found


def cut(docs: DataFrame, known: Known, rank_path: str, pattern: str) -> DataFrame:
    """doc_id with runs of known ids, the distinct other words as ranks of their bytes, and the places of both in the text.

    A place is the number of a run, or -1 less the number of a word. A worker holds ``AT_ONCE`` texts' pieces at a time.
    """
    byte = [int(x) for x in _tables(rank_path)[0].split(",")]
    shared, small = docs.sparkSession.sparkContext.broadcast(known), bytes(byte) if max(byte) < 256 else None
    names, kinds = ("runs", "words", "places"), (pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ids_of = finder(pattern), shared.value.ids.get
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part, columns = batch.slice(at, AT_ONCE), ([], [], [])
                for text in part.column(1).to_pylist():
                    runs, run, words, places = [], [], {}, []
                    for word in find(text) if text else ():
                        ids = ids_of(word)
                        if ids is not None:
                            run.append(ids)
                            continue
                        if run:
                            places.append(len(runs))
                            runs.append(" ".join(run))
                            run = []
                        places.append(-1 - words.setdefault(word, len(words)))
                    if run:
                        places.append(len(runs))
                        runs.append(" ".join(run))
                    encoded = map(str.encode, words)
                    for column, value in zip(columns, (runs, [list(w.translate(small)) for w in encoded] if small else [[byte[b] for b in w] for w in encoded], places)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", *names])

    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return read.mapInArrow(pieces, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<string>, words array<array<int>>, places array<int>")


def encode(docs: DataFrame, rank_path: str, pattern: str, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id and ids: decimal ids with one space between, for each row."""
    short_batches(docs.sparkSession)
    rank = rank_map(rank_path)
    known = dictionary(docs, pattern, rank, remembered) if remembered else Known()

    def placed(folded: Column) -> Column:
        return F.transform("places", lambda i: F.when(i < 0, F.get(folded, -1 - i)).otherwise(F.get("runs", i)))

    folded = _let(rank, lambda r: F.transform("words", lambda w: _joined(fold(w, r))))
    return cut(docs, known, rank_path, pattern).select("doc_id", F.array_join(_let(folded, placed), " ").alias("ids"))


def decode(ids: Column, rank_path: str) -> Column:
    """The bytes that decimal ids with spaces between stand for."""
    pieces = F.split(F.lit("\u0100".join(ranks(rank_path))), "\u0100")
    named = F.when(ids != "", F.split(ids, " "))
    return F.encode(F.coalesce(F.array_join(F.transform(named, lambda i: F.get(pieces, i.cast("int"))), ""), F.lit("")), "ISO-8859-1")


def report(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    out = encode(docs.select("doc_id", "text"), rank_path, pattern)
    n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.replace("ids", F.lit(" "), F.lit(""))) + 1).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), rank_path), 256).alias("decoded_sha256"))
