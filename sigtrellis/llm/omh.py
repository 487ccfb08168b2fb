"""Near-duplicate classes by Order MinHash, verified by banded alignment of words.

A text is its words, lower-cased (``\\w``-like: letters, digits and all bytes above
ASCII). Its k-mers are runs of two words, each labelled with how often it occurred
before. One sketch takes the two k-mers of least hash and keeps them in the order of
the text, so that moved passages don't agree; a text has ``SKETCHES`` of them. Texts of
at most ``EXACT`` words also have a key for each sequence that is left when as many
words are deleted as the similarity allows: two such texts that are similar always
share one.

Two texts are near duplicates if the edit distance of their words (insertions,
deletions, replacements), aligned in the band around the diagonal that the limit
leaves, is at most a fifth of the words of the longer one. Classes are the connected
components of verified pairs.

Equal word sequences are one node from the start, so copies never make pairs. In each
bucket of a key, without those nodes that none there is like in length, every node is compared with the least node (linear in the bucket), for
an eighth of the keys first, then for all others where that node isn't in its class
yet. Buckets that then still hold several classes are mixed. Their nodes are compared
with each other in the order of their lengths, by the parities of their words' counts in
several cells a word: an edit changes two parities at most, so that nothing similar is
lost. Only the pairs that lengths and parities leave are made, each in the least of the
buckets that both are in, and aligned. Larger buckets than ``SMALL`` are dealt in parts
of about that many nodes, and any two parts meet in one task. Pairs and classes
are tables in the shared folder at every step; nothing but whether one is empty comes
to the driver.

A text of one word has one k-mer, the whole text. Null texts and texts without a word
are each alone in their class. Repeated rows share a class; a doc_id that has several
texts takes the least of their classes. Rows whose doc_id is null are classed by their
text, and a class without any doc_id has a null id. An empty table has no classes.
Columns other than doc_id and text are neither read nor changed, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtrellis.llm.session import drop, parts, short_batches, table

K = 2
MINIMA = 2
SKETCHES = 32
#: Texts of up to so many words have keys by deletions, 106 at most.
EXACT = 14
#: Buckets of one in so many keys are compared first; members of a class that these find aren't compared again.
FIRST = 8
SIMILARITY = 0.8
#: Nodes of a mixed bucket that one task compares with each other; of a larger bucket, it takes two parts of so many.
SMALL = 4096
#: The documents are dealt in so many turns when their words are read, so that only a part of all texts is in shuffle files at a time.
TURNS = 2
#: Counts that words are put in order by.
CELLS = 1 << 18
#: Bits of a text's parities: these at least, and BITS_A_WORD for each word up to MOST_BITS, as a power of two.
BITS, BITS_A_WORD, MOST_BITS = 1024, 4, 1 << 17
_SPACES = bytes(b if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_SEEDS = np.random.default_rng(5).integers(1, 2**63, size=SKETCHES + MINIMA + K, dtype=np.uint64) | np.uint64(1)
_SCHEMA = "doc_id long, node binary, n int, keys array<long>"


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SPACES).split() if text else []


def node(w: list[bytes]) -> bytes:
    """Names a word sequence."""
    return hashlib.blake2b(b" ".join(w), digest_size=16).digest()


def numbers(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, w), dtype=np.uint32, count=len(w))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(ids: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each k-mer with its occurrence, in text order."""
    k = min(k, len(ids))
    ids = ids.astype(np.uint64)
    s = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    for j in range(k):
        s = _mix(s + ids[j : j + len(s)] * _SEEDS[SKETCHES + MINIMA + j])
    order = np.argsort(s, kind="stable")
    at = np.arange(len(s))
    same = np.concatenate(([False], s[order][1:] == s[order][:-1]))
    occurrence = np.zeros(len(s), dtype=np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
    return _mix(s + occurrence * np.uint64(0x9E3779B97F4A7C15))


def ordered(s: np.ndarray) -> np.ndarray:
    """The SKETCHES keys of k-mers."""
    keys = np.empty(SKETCHES, dtype=np.uint64)
    few = min(MINIMA, len(s))
    step = max(1, 1_000_000 // len(s))
    for a in range(0, SKETCHES, step):
        # the hashes are mixed already: an odd factor of its own orders them anew for each sketch
        z = s[None, :] * _SEEDS[a : min(a + step, SKETCHES), None]
        z ^= z >> np.uint64(32)
        least = np.sort(np.argpartition(z, few - 1, axis=1)[:, :few], axis=1)
        key = _SEEDS[a : a + len(z)].copy()
        for j in range(few):
            key = _mix(key + s[least[:, j]] * _SEEDS[SKETCHES + j])
        keys[a : a + len(z)] = key
    return keys.view(np.int64)


def left_over(ids: np.ndarray, least: float) -> np.ndarray:
    """A hash of each sequence that is left without as many words as ``least`` allows, or fewer."""
    seen, most = {()}, len(ids) - math.ceil(least * len(ids) - 1e-9)
    for gone in range(1, most + 1):
        seen |= set(itertools.combinations(range(len(ids)), gone))
    parts = {np.delete(ids, list(at)).tobytes() for at in seen}
    return np.array(sorted(int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in parts), dtype=np.int64)


def keys_of(ids: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Keys of a text's words: similar texts of up to EXACT words always have one in common, longer ones likely."""
    keys = ordered(kmers(ids))
    return np.concatenate([keys, left_over(ids, least)]) if len(ids) <= EXACT else keys


def _allowed(n: int, least: float) -> int:
    """Edits between texts of which the longer has n words."""
    return n - math.ceil(least * n - 1e-9)


def distance(p: list[int], t: list[int], most: int) -> int:
    """Edit distance of two sequences, exact up to ``most``, by a band of diagonals held in the bits of integers."""
    width = 2 * most + 1
    full, last = (1 << width) - 1, 1 << 2 * most
    at: dict[int, int] = {}
    for i, v in enumerate(p):
        at[v] = at.get(v, 0) | 1 << i
    # bit b of a column j stands for row j - most + b
    up, down = full & ~((1 << most) - 1), 0
    score, n = min(most, len(p)), len(p)
    for j, v in enumerate(t, 1):
        hit, shift = at.get(v, 0), j - most - 1
        hit = (hit >> shift if shift >= 0 else hit << -shift) & full
        same = ((((hit & up) + up) ^ up) | hit | down) & full
        right, left = (down | ~(same | up)) & full, same & up
        row = n - j + most
        if row >= width - 1:
            score += not same & last
        elif row >= 0:
            score += (right >> row & 1) - (left >> row & 1)
        moved = same >> 1
        down, up = moved & right, (left | ~(moved | right)) & full
    return score


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """One less the edit distance as a part of the longer one; 0 if it is certain to be below ``least``."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    most = _allowed(n, least)
    if not m or n - m > most:
        return 0.0
    differ = np.flatnonzero(a[:m] != b)
    head = int(differ[0]) if len(differ) else m
    differ = np.flatnonzero(a[::-1][: m - head] != b[::-1][: m - head])
    tail = int(differ[0]) if len(differ) else m - head
    x, y = a[head : n - tail], b[head : m - tail]
    if not len(x) or not len(y):
        edits = max(len(x), len(y))
    else:
        # words without a partner need an edit each
        words_, counts = np.unique(np.concatenate((x, y)), return_inverse=True)
        if len(x) - np.minimum(np.bincount(counts[: len(x)], minlength=len(words_)), np.bincount(counts[len(x) :], minlength=len(words_))).sum() > most:
            return 0.0
        edits = distance(x.tolist(), y.tolist(), most)
    return 1 - edits / n if edits <= most else 0.0


def _sketcher(least: float):
    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                w = words(text)
                if w:
                    rows.append((doc, node(w), len(w), keys_of(numbers(w), least)))
            out = pd.DataFrame(rows, columns=["doc_id", "node", "n", "keys"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return sketched


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        read = ((wanted, numbers(w)) for wanted, text in zip(batch["node"], batch["text"]) if node(w := words(text)) == bytes(wanted))
        yield pd.DataFrame([(wanted, ids.tobytes(), parities(ids).tobytes()) for wanted, ids in read], columns=["node", "ids", "bits"])


def rare(ids: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The rarest words, labelled with their occurrence: two similar texts have one of them in common, whatever ``common`` counts."""
    s = kmers(ids, 1)
    order = np.lexsort((s, common[(s % np.uint64(len(common))).astype(np.int64)]))
    return s[order[: _allowed(len(ids), least) + 1]].view(np.int64)


def parities(ids: np.ndarray) -> np.ndarray:
    """Whether the words of each cell are odd in number, as long integers. An edit changes two bits at most.

    Words are labelled with their occurrence, so that even counts of a repeated word tell too.
    """
    bits = min(max(BITS, 1 << (BITS_A_WORD * len(ids) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((kmers(ids, 1) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parities in fewer cells: ``size`` long integers, a power of two."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def alike(rows: pd.DataFrame, least: float) -> Iterator[tuple[bytes, bytes]]:
    """The pairs of two labels in one group whose lengths and parities allow similarity, where the group's key is the least that both have.

    Only a replacement changes two parities, so that a difference of lengths counts once more. Rows are key, low, high, part, node, n, label, bits and buckets, whole groups (key, low, high) one after
    another, by n. Groups of two parts (low and high) pair nodes of different ones.
    """
    group = np.cumsum(np.any([np.diff(rows[c].to_numpy(), prepend=0) != 0 for c in ("key", "low", "high")], axis=0))
    key, n, part, whole = rows["key"].to_numpy(), rows["n"].to_numpy(), rows["part"].to_numpy(), (rows["low"] == rows["high"]).to_numpy()
    label, nodes, buckets = pd.factorize(rows["label"])[0], rows["node"].tolist(), [set(x) for x in rows["buckets"]]
    most = 2 * (n - np.ceil(least * n - 1e-9))
    bits = [np.frombuffer(x, dtype=np.uint64) for x in rows["bits"]]
    size = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits))
    levels = []
    for width in np.unique(np.append(size, BITS // 64)):
        has = np.flatnonzero(size >= width)
        place = np.zeros(len(rows), dtype=np.int64)
        place[has] = np.arange(len(has))
        levels.append((width, place, np.stack([folded(bits[i], width) for i in has])))
    at, step = np.arange(len(rows)), 0
    while len(at):
        step += 1
        at = at[at + step < len(rows)]
        # by n: where one is too long, so are all behind it
        at = at[(group[at] == group[at + step]) & (n[at] >= least * n[at + step] - 1e-9)]
        a = at[(label[at] != label[at + step]) & (whole[at] | (part[at] != part[at + step]))]
        for width, place, of in levels:
            # the coarsest parities of all, then the finest that both have
            told = np.ones(len(a), dtype=bool) if width == BITS // 64 else np.minimum(size[a], size[a + step]) == width
            x = a[told]
            fits = ~told
            fits[told] = np.bitwise_count(of[place[x]] ^ of[place[x + step]]).sum(axis=1, dtype=np.int64) <= most[x + step] - (n[x + step] - n[x])
            a = a[fits]
        for i in a.tolist():
            if min(buckets[i] & buckets[i + step]) == key[i]:
                yield (nodes[i], nodes[i + step]) if nodes[i] < nodes[i + step] else (nodes[i + step], nodes[i])


def _alike(least: float):
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = batch if held is None else held if batch is None else pd.concat((held, batch), ignore_index=True)
            if rows is None or not len(rows):
                continue
            end = len(rows)
            if batch is not None:  # the last group may go on
                last = rows.iloc[-1]
                end = int(((rows["key"] == last["key"]) & (rows["low"] == last["low"]) & (rows["high"] == last["high"])).to_numpy().argmax())
            found = alike(rows[:end], least) if end else iter(())
            while some := list(itertools.islice(found, 10_000)):
                yield pd.DataFrame(some, columns=["a", "b"])
            held = rows[end:].reset_index(drop=True)

    return pairs


def verifier(least: float):
    @F.pandas_udf("double")
    def verify(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32), least) for x, y in zip(a, b)], dtype="float64")

    return verify


def components(edges: DataFrame, name: str, most: int) -> DataFrame:
    """node and label (the least node of its component) for every node of edges(a, b).

    Labels spread to neighbours and then jump to the label of their label, so the
    rounds grow with the logarithm of the longest path. Each round is a table, of ``most`` parts at most.
    """
    both = table(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).coalesce(most), f"{name}-edges")
    labels = table(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")).coalesce(most), f"{name}-0")
    for turn in itertools.count(1):
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        near = labels.join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = near.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        fresh = table(jump.select("node", "was", F.coalesce(F.least("label", "far"), F.col("label")).alias("label")).coalesce(most), f"{name}-{turn}")
        drop(labels)
        labels = fresh
        if fresh.where(F.col("was") != F.col("label")).isEmpty():
            drop(both)
            return labels.select("node", "label")


def _verified(pairs: DataFrame, ids: DataFrame, least: float, name: str) -> DataFrame:
    pairs = table(pairs.distinct(), name)
    whole = pairs.join(ids.select(F.col("node").alias("a"), F.col("ids").alias("x")), "a").join(ids.select(F.col("node").alias("b"), F.col("ids").alias("y")), "b")
    found = table(whole.select("a", "b", verifier(least)("x", "y").alias("similarity")).where(F.col("similarity") >= least), f"verified-{name}")
    drop(pairs)
    return found


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of their node; a node without links is its own class."""
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def links(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The rows' nodes (doc_id, node, n, ...), and the class of every linked node (node, label)."""
    short_batches(docs.sparkSession)
    sketches = table(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(_sketcher(least), _SCHEMA), "sketches")
    few = parts(sketches)
    nodes = table(sketches.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys")).coalesce(few), "nodes")
    rows = table(sketches.select("doc_id", "node", "n").coalesce(few), "rows")
    drop(sketches)
    placed = nodes.select("node", "n", F.explode("keys").alias("key"))
    several = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1).select("key")
    buckets = _buckets(placed.join(several, "key"), least, few)
    needed = table(buckets.select("node").distinct().join(nodes.select("node", "doc_id"), "node").coalesce(few), "needed")
    drop(nodes)
    texts = [_texts(docs, needed, turn) for turn in range(TURNS)]
    ids = functools.reduce(DataFrame.unionByName, texts)
    drop(needed)
    # texts of lengths that rule similarity out never meet their leader
    fits = F.least("n", "leader_n") >= least * F.greatest("n", "leader_n") - 1e-9
    followers = buckets.where((F.col("node") != F.col("leader")) & fits)
    first = followers.where(F.pmod("key", F.lit(FIRST)) == 0)
    edges = _verified(first.select(F.col("leader").alias("a"), F.col("node").alias("b")), ids, least, "stars")
    labels = components(edges, "first", parts(edges))
    # all other leaders, against those that aren't in their class yet; a node leads only as many buckets as it has keys
    leading = buckets.where(F.col("node") == F.col("leader")).select("key", "node").join(labels, "node").select("key", F.col("label").alias("leading"))
    apart = _labelled(followers, labels).join(leading, "key", "left").where(F.col("label") != F.coalesce("leading", "leader"))
    more = _verified(apart.select(F.col("leader").alias("a"), F.col("node").alias("b")), ids, least, "more-stars")
    found = [edges]
    if not more.isEmpty():
        found.append(more)
        labels = components(functools.reduce(DataFrame.unionByName, found), "second", parts(*found))
    # what is left of a bucket of several classes, but its leader, which all were compared with
    few = parts(buckets)
    named = table(_labelled(buckets, labels).coalesce(few), "labelled")
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where(F.col("low") != F.col("high"))
    mixed = table(named.where(F.col("node") != F.col("leader")).join(mixed.select("key", "size"), "key").select("key", "size", "node", "n", "label").coalesce(few), "mixed")
    last = _verified(_mixed_pairs(mixed, ids, least), ids, least, "mixed-pairs")
    if not last.isEmpty():
        found.append(last)
        labels = components(functools.reduce(DataFrame.unionByName, found), "third", parts(*found))
    drop(buckets, *texts, named, mixed, last)
    return rows, labels


def _buckets(placed: DataFrame, least: float, most: int) -> DataFrame:
    """Rows (node, n, key) with their key's least node and its n, but only those with another of a like length: in the order of lengths, that is one beside it."""
    by = Window.partitionBy("key")
    beside = placed.select("*", F.lag("n").over(by.orderBy("n")).alias("before"), F.lead("n").over(by.orderBy("n")).alias("behind"))
    fits = (F.col("before") >= least * F.col("n") - 1e-9) | (F.col("n") >= least * F.col("behind") - 1e-9)
    led = beside.where(fits).select("key", "node", "n", F.min(F.struct("node", "n")).over(by).alias("least"))
    return table(led.select("key", "node", "n", F.col("least.node").alias("leader"), F.col("least.n").alias("leader_n")).coalesce(most), "buckets")


def _texts(docs: DataFrame, needed: DataFrame, turn: int) -> DataFrame:
    """node, ids and bits of the needed (node, doc_id) of one turn, as a table."""
    now = F.pmod(F.xxhash64("doc_id"), F.lit(TURNS)) == turn
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).where(now).join(needed.where(now), "doc_id")
    return _once(table(read.select("node", "text").mapInPandas(_read, "node binary, ids binary, bits binary"), f"texts-{turn}"))


def _once(texts: DataFrame) -> DataFrame:
    """Each node once. Only repeated rows of one doc_id repeat a node, so that few tables have to be dealt and written again."""
    if texts.groupBy("node").count().where(F.col("count") > 1).isEmpty():
        return texts
    once = table(texts.dropDuplicates(["node"]), "texts-once")
    drop(texts)
    return once


def _mixed_pairs(mixed: DataFrame, ids: DataFrame, least: float) -> DataFrame:
    """Pairs of nodes of two classes in one bucket (key, size, node, n, label) whose lengths and parities allow similarity, each once."""
    held = mixed.groupBy("node").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_list(F.struct("key", "size")).alias("held"))  # as many as a node has keys
    each = held.join(ids.select("node", "bits"), "node").select("node", "n", "label", "bits", F.col("held.key").alias("buckets"), F.explode("held").alias("own"))
    parts = F.ceil(F.col("own.size") / SMALL)
    dealt = each.select("node", "n", "label", "bits", "buckets", F.col("own.key").alias("key"), F.pmod(F.xxhash64("node"), parts).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    dealt = dealt.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "n", "label", "bits", "buckets")
    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "n").mapInPandas(_alike(least), "a binary, b binary")


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) for each row."""
    rows, labels = links(docs, least)
    named = rows.select("doc_id", "node").join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    least_id = table(named.groupBy("label").agg(F.min("doc_id").alias("class_id")).coalesce(parts(rows)), "class-ids")
    own = named.join(least_id, "label").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return every.join(own, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class, that of least doc_id, once; rows without a doc_id stay as they are."""
    kept = classes(docs.where(F.col("doc_id").isNotNull()), least).where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, docs["doc_id"].cast("long") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
