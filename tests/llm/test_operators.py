"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("sigtrellis.llm")

import public_tokenizers as P  # noqa: E402
import sentencepiece  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sigtrellis.llm import ann, boosting, bpe, chat, decontam, html, linededup, omh, pii, tokens, toxicity  # noqa: E402

DOCS = "doc_id long, text string, leak string, dropped int, n_chars long"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def docs(spark, texts):
    rows = [(i, t, "x", 1, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(r.randint(0, 300)) for _ in range(n))


ODD = [None, "", " ", "\n\n", "a", "é" * 50, "\x00\x01", "x" * 200_000, "'s 'll  tabs\t\tand　wide", "🙂🙂 日本語 text"]


# 1 nearest neighbours

def brute_neighbours(rows, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0}
    out = {}
    for q in (i for i in good if i % 50 == 0):
        s = sorted((-(good[q] @ v) / np.linalg.norm(good[q]) / np.linalg.norm(v), i) for i, v in good.items() if i != q)
        out[q] = [i for _, i in s[:k]]
    return out


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (9, [1.0, 2.0]), (50, [0.0, 3.0]), (10, [1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(t, t.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_neighbours([r for r in rows if r[0] != 10], 5)
    assert ann.search(t.limit(0), t.limit(0)).count() == 0


def test_neighbours_recall_and_hot_vector(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[500:1000] = x[7]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(t, t.where("vec_id % 50 = 0")).collect()
    want, got = brute_neighbours([(i, v.tolist()) for i, v in enumerate(x)], 5), {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(x[r.query_id] @ x[r.vec_id] / np.linalg.norm(x[r.query_id]) / np.linalg.norm(x[r.vec_id]), abs=1e-12)
    assert np.mean([len(got[q] & set(w)) / 5 for q, w in want.items()]) >= 0.9
    assert sorted(got[500]) == [7, 501, 502, 503, 504]


def test_blocks_do_not_change_neighbours(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(400, 8))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = t.where("vec_id % 50 = 0")
    whole = ann.search(t, q).collect()
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    assert sorted(whole) == sorted(ann.search(t, q).collect())


def test_repeated_ids_count_once(spark):
    x = np.random.default_rng(6).normal(size=(30, 8))
    rows = [(i, (x[i] + 1e-9 * j).tolist()) for i in range(30) for j in range(12)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(t, t.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in found] == brute_neighbours([(i, v.tolist()) for i, v in enumerate(x)], 5)[0]


# 2 personal data

def test_pseudonyms_keep_format_and_links(spark):
    text = "card 4111 1111 1111 1111, 4111-1111-1111-1111 not 4111 1111 1111 1112; +1 (743) 555-3824; 10.0.200.7 not 300.1.1.1; 2024-02-29 or 02/29/2024 or 29.02.2024, no 2023-02-29; 123-45-6789, no 666-45-6789; DE89370400440532013000; ann@example.com"
    out = {r.doc_id: r for r in pii.report(docs(spark, [text, text.upper().lower(), *ODD]), "k").collect()}
    new, kinds = out[0].text, out[0].kinds
    assert kinds == "card,date,email,iban,ip,phone,ssn"
    cards = re.findall(r"card ([\d ]+), ([\d-]+) not (.{19})", new)[0]
    assert cards[0].replace(" ", "") == cards[1].replace("-", "") != "4111111111111111" and cards[2] == "4111 1111 1111 1112"
    digits = [int(c) for c in cards[0].replace(" ", "")]
    assert sum(sum(divmod(d * 2, 10)) if i % 2 == 0 else d for i, d in enumerate(digits)) % 10 == 0
    for kept in ("300.1.1.1", "2023-02-29", "666-45-6789", "DE" ):
        assert kept in new
    for gone in ("555-3824", "10.0.200.7", "2024-02-29", "02/29/2024", "29.02.2024", "123-45-6789", "DE89370400440532013000", "ann@"):
        assert gone not in new
    iso, us, de = re.search(r"(\d{4}-\d\d-\d\d) or (\d\d/\d\d/\d{4}) or (\d\d\.\d\d\.\d{4}),", new).groups()
    assert iso == f"{us[6:]}-{us[:2]}-{us[3:5]}" == f"{de[6:]}-{de[3:5]}-{de[:2]}"
    iban = re.search(r"DE\d{20}", new).group()
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    for i, t in enumerate(ODD):
        assert out[i + 2].text == t and out[i + 2].n_numbers == 0
    assert pii.report(docs(spark, [text]), "other").first().text != new


def test_feistel_is_a_permutation(spark):
    cells = spark.range(189 * 6).select(F.array((F.col("id") / 6).cast("int"), (F.col("id") % 6).cast("int")).alias("x"))
    got = cells.select(pii.feistel(F.col("x"), F.array(F.lit(189), F.lit(6)), "k", "t").alias("y")).distinct()
    assert got.count() == 189 * 6


def _luhn(digits):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_numbers_side_by_side_are_found_apart(spark):
    card, iban, hexa = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    texts = [
        "a 4111111111111111 4111111111111111 b",
        f"{card} 12/27",
        f"{card} 123.",
        f"{card} {card}",
        f"{iban} THE 12",
        f"{iban} CODE 1234",
        "call +1 (017) 555-7713 or (217) 555-7713",
        f"TOKEN = {hexa}! token = {hexa.lower()}!",
        "1234 5678 9012 3456 78 stays",
    ]
    table = docs(spark, [*texts, texts[0]]).withColumn("_matches", F.lit(3)).withColumn("_found", F.lit("mine"))
    rows = {r.doc_id: r for r in pii.pseudonymise(table, "k").collect()}
    assert {(r._1, r._2) for r in spark.createDataFrame([(r["_matches"], r["_found"]) for r in rows.values()]).collect()} == {(3, "mine")}
    out = {i: r.pii.text for i, r in rows.items()}
    bare = out[0].split()[1]
    assert bare != "4111111111111111" and _luhn(bare) and out[0] == f"a {bare} {bare} b" == out[9]
    four = " ".join(bare[i : i + 4] for i in range(0, 16, 4))
    assert [out[i] for i in (1, 2, 3)] == [f"{four} 12/27", f"{four} 123.", f"{four} {four}"]
    other = out[4][: len(iban)]
    assert other != iban and out[4] == f"{other} THE 12" and out[5] == f"{other} CODE 1234"
    flat = other.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert re.fullmatch(r"call \+1 \([01]\d\d\) [2-9]\d\d-\d{4} or \([2-9]\d\d\) [2-9]\d\d-\d{4}", out[6]) and "555-7713" not in out[6]
    upper = re.fullmatch(r"TOKEN = ([0-9A-F]{40})! token = ([0-9a-f]{40})!", out[7])
    assert upper and upper[1].lower() == upper[2] != hexa.lower()
    assert out[8] == texts[8]
    assert pii.report(docs(spark, []), "k").count() == 0


# 3 decontamination

def brute_leaks(text, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = fold(text), set(), set()
    for i, t in items:
        x = fold(t)
        for s in [x[k : k + 10] for k in range(max(1, len(x) - 9))] if x else []:
            for p in range(len(w) - len(s) + 1):
                if w[p : p + len(s)] == s:
                    hit |= set(range(p, p + len(s)))
                    found.add(str(i))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


@pytest.mark.parametrize("most", [400_000, 20])
def test_leaks(spark, most):
    base = prose(1, 60)
    items = [(1, base), (2, "Short ITEM here"), (3, None), (4, ""), (10, " ".join(base.split()[20:40])), (2, "Short ITEM here")]
    texts = [*ODD, base, "x " + " ".join(base.split()[5:17]).upper() + " y", "a short item, here b", "short item hereb", " ".join(base.split()[:9]), prose(2, 300) + " " + base, "short item here " * 50]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.report(docs(spark, texts), b, max_windows=most).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_leaks(t, items)
    a, z = got[len(ODD) + 1].spans[0]
    assert texts[len(ODD) + 1][a:z] == " ".join(base.split()[5:17]).upper()
    kept = decontam.clean(docs(spark, texts), b)
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute_leaks(t, items)[4]}
    assert decontam.report(docs(spark, texts).limit(0), b).count() == 0
    assert not any(r.contaminated for r in decontam.report(docs(spark, texts), b.limit(0)).collect())


# 4 near duplicates

def test_near_duplicate_classes(spark):
    base = prose(3, 200).split()
    edited = [w if i % 25 else "changed" for i, w in enumerate(base)]
    moved = base[100:] + base[:100]
    texts = [" ".join(base), " ".join(edited), " ".join(base).upper() + "!", " ".join(moved), prose(9, 200), None, "", "one two", "one  two.", "two one", prose(4, 20_000)]
    got = {r.doc_id: r.class_id for r in omh.classes(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10}
    kept = omh.keep(docs(spark, texts).unionByName(docs(spark, texts)))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 9, 10] and kept.columns == docs(spark, []).columns
    assert omh.classes(docs(spark, texts).limit(0)).count() == 0


def test_large_group_and_shared_passage(spark):
    base = prose(5, 120).split()
    passage = prose(6, 60)
    near = [" ".join(w if i != k % 120 else f"new{k}" for i, w in enumerate(base)) for k in range(150)]
    mixed = [f"{prose(100 + k, 60)} {passage} {prose(400 + k, 60)}" for k in range(150)]
    got = {r.doc_id: r.class_id for r in omh.classes(docs(spark, near + mixed)).collect()}
    assert {got[i] for i in range(150)} == {0} and all(got[i] == i for i in range(150, 300))


def similar_pair(r, n, changes):
    """Numbers of n words, and a copy with so many of them replaced."""
    a = np.array([r.randint(1, 2**32 - 1) for _ in range(n)], np.uint32)
    b = a.copy()
    b[r.sample(range(n), changes)] = [r.randint(1, 2**32 - 1) for _ in range(changes)]
    return a, b


def test_similar_texts_share_a_key_down_to_the_threshold():
    r, shared = random.Random(8), lambda a, b: len(np.intersect1d(omh.keys_of(a), omh.keys_of(b))) > 0
    for n in range(5, omh.EXACT + 1):
        for _ in range(20):
            a, b = similar_pair(r, n, n // 5)
            assert shared(a, b) and (omh.similarity(a, a[1:]) < 0.8 or shared(a, a[1:]))
    for n in (15, 20, 30, 35, 39, 40, 50, 100, 200, 600):
        found = [shared(*similar_pair(r, n, n // 5)) for _ in range(100)]
        assert np.mean(found) >= 0.95, (n, np.mean(found))
    assert np.mean([shared(r1, r1[: int(len(r1) * 0.8) + 1]) for r1 in (similar_pair(r, n, 0)[0] for n in range(36, 48))]) == 1


def test_classes_of_barely_similar_texts(spark):
    r, texts = random.Random(9), []
    for k in range(60):
        n = (5, 8, 10, 12, 14, 17, 24, 38, 44, 120)[k % 10]
        w = [f"w{k}x{i}" for i in range(n)]
        changed = w[:]
        for i in r.sample(range(n), n // 5):
            changed[i] += "new"
        texts += [" ".join(w), " ".join(changed)]
    got = {x.doc_id: x.class_id for x in omh.classes(docs(spark, texts)).collect()}
    assert all(got[2 * k] == 2 * k for k in range(60))
    linked = [got[2 * k + 1] == 2 * k for k in range(60)]
    assert all(x for k, x in enumerate(linked) if k % 10 < 5) and sum(linked) >= 58


@pytest.mark.parametrize("small", [2, 1000])
def test_pairs_apart_from_their_leader_are_linked(spark, monkeypatch, small):
    # all texts meet in one bucket, whose leader is similar to none of them
    monkeypatch.setattr(omh, "SMALL", small)
    monkeypatch.setattr(omh, "keys_of", lambda ids, least: np.zeros(1, np.int64))
    texts = []
    for k in range(20):
        w = [f"w{k}x{i}" for i in range(60)]
        texts += [" ".join(w), " ".join(x + f" new{k}" * (i % 10 == 3) for i, x in enumerate(w) if i % 10 != 1)]
    first = min(omh.node(omh.words(x)) for x in texts)
    texts.append(next(t for t in map("alone{}".format, range(10**5)) if omh.node(omh.words(t)) < first))
    got = {x.doc_id: x.class_id for x in omh.classes(docs(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(41)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_similarity_is_that_of_edits():
    r, seen = random.Random(1), 0
    for _ in range(600):
        a = [r.randint(0, r.choice([2, 9, 50])) for _ in range(r.randint(1, 45))]
        b = [y for x in a for y in r.choice([[x]] * 12 + [[], [r.randint(0, 9)], [x, r.randint(0, 9)]])] or [0]
        most, d = max(len(a), len(b)), edits(a, b)
        got = omh.similarity(np.array(a, np.uint32), np.array(b, np.uint32))
        assert got == (1 - d / most if d <= omh._allowed(most, 0.8) else 0), (a, b)
        seen += got > 0
    assert seen > 200


def test_repeated_words_share_keys():
    a = similar_pair(random.Random(2), 60, 0)[0]
    assert len(np.intersect1d(omh.kmers(a), omh.kmers(np.concatenate((a, a[:5]))))) == 59
    assert len(np.intersect1d(omh.keys_of(a), omh.keys_of(np.concatenate((a, a[:5]))))) > 20


def test_rare_words_miss_no_similar_pair():
    r, common = random.Random(3), np.zeros(omh.CELLS, np.int64)
    for _ in range(300):
        a, b = similar_pair(r, r.randint(5, 80), 0)
        n = len(a)
        b[r.sample(range(n), n // 5)] = r.randint(1, 9)
        common[[r.randrange(omh.CELLS) for _ in range(50)]] += 1
        assert len(np.intersect1d(omh.rare(a, common, 0.8), omh.rare(b, common, 0.8))) or omh.similarity(a, b) < 0.8
        differ = np.unpackbits((omh.parities(a) ^ omh.parities(b)).view(np.uint8)).sum()
        assert differ <= 2 * omh._allowed(max(len(a), len(b)), 0.8) or omh.similarity(a, b) < 0.8


def test_pairs_of_a_bucket_are_aligned_only_where_their_words_allow(spark, monkeypatch):
    # buckets of a class, and of texts that share 73 % of their words with it, which is just too few
    monkeypatch.setattr(omh, "SMALL", 4)
    monkeypatch.setattr(omh, "keys_of", lambda ids, least: np.arange(3))  # three such buckets
    made, verified = [], omh._verified
    monkeypatch.setattr(omh, "_verified", lambda pairs, ids, least, name: made.append((name, pairs.count(), pairs.distinct().count())) or verified(pairs, ids, least, name))
    r, texts = random.Random(12), []
    for k, changes in [(k, 8) for k in range(15)] + [(k, 216) for k in range(15, 30)]:
        w = [f"w{i}" for i in range(800)]
        for i in r.sample(range(800), changes):
            w[i] = f"new{k}x{i}"
        texts.append(" ".join(w))
    got = {x.doc_id: x.class_id for x in omh.classes(docs(spark, texts)).collect()}
    assert all(got[k] == (0 if k < 15 else k) for k in range(30))
    assert all(n == once for name, n, once in made if name == "mixed-pairs") and dict(x[:2] for x in made)["mixed-pairs"] <= 15 * 14 // 2 + 5, made


def test_parities_and_buckets_lose_no_similar_pair(monkeypatch):
    r, rows = random.Random(13), []
    for k in range(40):
        n = r.choice((30, 240, 260, 520, 1100))
        a, b = similar_pair(r, n, n // 5)
        for x in (a, b, a[: n - n // 6]):
            for key in (keys := sorted(r.sample(range(6), 2) + [6])):
                rows.append((key, 0, 0, 0, b"%d" % len(rows), len(x), b"%d" % len(rows), omh.parities(x).tobytes(), keys, x))
    names = ["key", "low", "high", "part", "node", "n", "label", "bits", "buckets", "x"]
    frame = omh.pd.DataFrame([(*row[:4], b"t%04d" % (k // 3), row[5], b"t%04d" % (k // 3), *row[7:]) for k, row in enumerate(rows)], columns=names)
    text = dict(zip(frame["node"], frame["x"]))
    held = dict(zip(frame["node"], map(set, frame["buckets"])))
    want = {(a, b) for a in text for b in text if a < b and held[a] & held[b] and omh.similarity(text[a], text[b]) >= 0.8}
    frame = frame.sort_values(["key", "low", "high", "n"], ignore_index=True)
    got = list(omh.alike(frame, 0.8))
    assert len(want) >= 80 and want <= set(got) and len(got) == len(set(got)) < 2 * len(want)
    batches = (frame[i : i + 7].reset_index(drop=True) for i in range(0, len(frame), 7))
    assert sorted(tuple(x) for out in omh._alike(0.8)(batches) for x in out.itertuples(index=False)) == sorted(got)
    one, many = similar_pair(r, 900, 0)[0], omh.parities(np.arange(900, dtype=np.uint32))
    monkeypatch.setattr(omh, "MOST_BITS", 1024)
    assert (omh.folded(many, 16) == omh.parities(np.arange(900, dtype=np.uint32))).all() and len(omh.parities(one)) == 16


def test_texts_are_read_in_turns_and_once(spark, monkeypatch):
    made, write = {}, omh.table

    def counted(df, name):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(omh, "table", counted)
    base = prose(14, 80)
    d = docs(spark, [f"{base} new{k}" for k in range(60)])
    assert {x.class_id for x in omh.classes(d.unionByName(d)).collect()} == {0}
    read = [n for name, n in made.items() if name.startswith("texts-") and name != "texts-once"]
    assert sum(read) == 120 and max(read) < 90, made


def test_small_tables_have_few_files_whatever_the_partitions(spark, monkeypatch):
    files, write = {}, omh.table

    def counted(df, name):
        out = write(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(omh, "table", counted)
    base = prose(15, 80)
    texts = [f"{base} new{k}" if k % 2 else prose(k, 40) for k in range(60)] + [prose(k, 40) for k in range(60)]
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {x.doc_id: x.class_id for x in omh.classes(docs(spark, texts)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: 1 if k < 60 and k % 2 else k - 60 if k >= 60 and k % 2 == 0 else k for k in range(120)}
    small = {name: n for name, n in files.items() if re.fullmatch("nodes|rows|buckets|needed|first-.*|labelled|mixed|class-ids", name)}
    assert len(small) >= 10 and max(small.values()) <= spark.sparkContext.defaultParallelism, files


def test_classes_are_those_of_all_pairs(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(x.doc_id, omh.numbers(omh.words(x.text))) for x in d.collect()]
    least = {i: i for i, _ in rows}

    def top(i):
        return i if least[i] == i else top(least[i])

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if len(a) and len(b) and omh.similarity(a, b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                least[y] = x
    assert {x.doc_id: x.class_id for x in omh.classes(d).collect()} == {i: top(i) for i in least}


# 5 lines

def brute_lines(texts, least=5):
    key = lambda x: k if len(k := "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))) >= 40 else None
    who = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            who.setdefault(key(x), set()).add(i)
    bad = {k: max(v) for k, v in who.items() if k and len(v) >= least}
    return ["\n".join(x for x in (t or "").split("\n") if bad.get(key(x), i) == i) for i, t in enumerate(texts)]


def test_lines(spark):
    line, other = "This Line Is Certainly Long Enough To Be Counted", "é" * 40
    texts = [f"own {i}\n {line.upper() if i % 2 else line}\t\n{line}\n{'short'}\n" + (other if i < 4 else "end") for i in range(7)] + [line[:39]] * 6 + [other, "\n" * 200 + line] + ODD
    got = {r.doc_id: r for r in linededup.report(docs(spark, texts)).collect()}
    for i, want in enumerate(brute_lines(texts)):
        n = len((texts[i] or "").split("\n"))
        assert (got[i].n_lines, got[i].n_lines - got[i].n_dropped, got[i].kept_sha256) == (n, len(want.split("\n")) if got[i].n_dropped < n else 0, sha(want)), i
    twice = linededup.clean(docs(spark, texts).unionByName(docs(spark, texts)))
    assert twice.count() == 2 * len(texts) and twice.columns == docs(spark, []).columns
    assert linededup.report(docs(spark, texts).limit(0)).count() == 0


# 6 byte-level BPE

def test_words_are_found_as_the_regex_library_finds_them(monkeypatch):
    every = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    texts = [t for t in ODD if t] + ["".join(every[:0xF800]), " ".join(every[:0xF800]), "".join(every), "a".join(every[:0xF800]), "1 ".join(every)]
    random.Random(8).shuffle(every)
    texts += ["".join(every), "".join(c for c in every if c < "\U00010000")]
    for pattern in (P.PATTERN, r"[^\s\p{N}]+|\p{N}|\s+", r"\p{Lu}+|(?i:'s)|[^\p{Lu}]"):
        find, want = bpe.finder(pattern), bpe.regex.compile(bpe.spelled_out(pattern)).findall
        assert all(find(t) == want(t) for t in texts)
    # the slower library is only for characters beyond U+FFFF
    bpe.finder.cache_clear()
    monkeypatch.setattr(bpe.regex, "compile", lambda pattern: re.compile("(?!)"))
    assert bpe.finder(P.PATTERN)("it's 2 é") == ["it", "'s", " 2", " é"] and bpe.finder(P.PATTERN)("\U0001F642") == []
    bpe.finder.cache_clear()


def test_words_are_counted_in_a_part_of_the_texts(spark):
    d = docs(spark, [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)] + [None, ""])
    seen = bpe.counts(d, P.PATTERN).where("word like 'word%'").count()
    assert 400 / bpe.COUNT_OF / 2 < seen < 400 / bpe.COUNT_OF * 2
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids_sha256 for r in bpe.report(d, path, P.PATTERN).collect()}
    assert got == {r.doc_id: sha(" ".join(map(str, library.encode_ordinary(r.text or "")))) for r in d.collect()}


@pytest.mark.parametrize("remembered", [0, 500])
def test_bpe_round_trip(spark, remembered):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    long = ["".join(r.choice(letters) for _ in range(n)) for letters, n in (("ab", 3000), ("thequickandlazy", 1500), ("aaab", 49), ("einatshor", 60), ("日本語", 40))]
    texts = ODD + long + ["".join(r.choice("aeinotsh") for _ in range(r.randint(1, 48))) for _ in range(150)] + ["zx" * 300, "Unhappily, they're re-reading 12345 naïve façades…  \r\n\t end ", "<|endoftext|>", " leading", "\ue000\ue001\ue002", prose(1, 50)] * 2
    got = {r.doc_id: r for r in bpe.encode(docs(spark, texts), path, P.PATTERN, remembered).withColumn("raw", bpe.decode(F.col("ids"), path)).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == " ".join(map(str, library.encode_ordinary(t or ""))), t
        assert bytes(got[i].raw) == (t or "").encode()
    wide = docs(spark, texts[:3]).withColumn("ids", F.lit(1)).withColumn("cut", F.lit(2))
    assert bpe.report(wide, path, P.PATTERN).count() == 3 and bpe.report(wide.limit(0), path, P.PATTERN).count() == 0


def test_a_vocabulary_without_merges_is_refused():
    with pytest.raises(ValueError):
        bpe.pairs([chr(i) for i in range(256)] + ["abc"])


# 7 pages

PAGE = """<html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body><header>Site</header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><aside>Side</aside>
<article><h1>Head &amp; tail</h1><p>First   para<br>graph with <a href=y>a link</a>.<p>Second&nbsp;one.<ul><li>x<li>y</ul></article>
<div id="comments"><p>A reader wrote this long comment about everything.</p></div><form><input value=q>Send</form><footer>Foot</footer></body></html>"""


def test_pages(spark):
    pages = spark.createDataFrame([(0, "u", PAGE, 1), (1, None, None, 1), (2, "u", "", 1), (3, "u", "just text & more", 1), (4, "u", "<p>open <b>never closed", 1), (5, "u", "<div>" * 3000 + "deep", 1), (6, "u", "<!-- no --><script>x</script>", 1)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html.texts(pages).collect()}
    assert got[0].text == "Head & tail\nFirst para graph with a link.\nSecond one.\nx\ny"
    assert [got[i].text for i in range(1, 7)] == ["", "", "just text & more", "open never closed", "deep", ""]
    assert got[0].n_chars == len(got[0].text) and html.texts(pages.limit(0)).count() == 0


def test_page_without_article():
    body = "<div id=menu><a>a</a><a>b</a></div><div class=story>" + "".join(f"<p>Paragraph {i} has quite some words to be the main text of this page.</p>" for i in range(5)) + "</div><div class=sidebar><p>No</p></div>"
    assert html.extract(f"<body>{body}</body>").split("\n") == [f"Paragraph {i} has quite some words to be the main text of this page." for i in range(5)]


def plain_densities(node):
    """Characters, tags, link characters, link tags of a node by their definition."""
    inside = [plain_densities(k) for k in node.kids if isinstance(k, html.Node) and k.tag not in html._UNSEEN]
    chars = sum(len("".join(k.split())) for k in node.kids if isinstance(k, str)) + sum(x[0] for x in inside)
    tags, link_tags = sum(x[1] + 1 for x in inside), sum(x[3] for x in inside)
    return (chars, tags, chars, link_tags + 1) if node.tag == "a" else (chars, tags, sum(x[2] for x in inside), link_tags)


def test_densities_choose_whatever_the_tags_are(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for h in pages:
        plain = re.sub(r"(</?)(article|main)\b", r"\1div", h)
        assert plain != h and html.extract(plain) == html.extract(h) != ""
    tree = html.Tree()
    tree.feed(pages[0])
    nodes = html._walk(tree.root)
    html._measure(nodes)
    for n, _ in nodes:
        assert (n.chars, n.tags, n.link_chars, n.link_tags) == plain_densities(n)
        assert n.total == pytest.approx(sum(k.density for k in n.kids if isinstance(k, html.Node) and k.tag not in html._UNSEEN))


# 8 token counts

def test_token_counts(spark):
    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    texts = ODD + ["".join(r.choice(" ▁\tabcdé<s>/日本🙂\n") for _ in range(r.randint(0, 40))) for _ in range(300)] + ["word " * 5000]
    got = {x.doc_id: x for x in tokens.count_tokens(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)


# 9 chats

def brute_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, role or "", x or "") for d, t, role, x in rows if d == c), key=lambda v: (v[0] is not None, v))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        out[c] = (len(turns), sha("".join(f"{a}\n{x}\n" for _, a, x in turns)), len(loss), sha(loss))
    return out


def test_chats(spark):
    posed = ["</s>[INST] ok [/INST]", "\\</s>", "ends with \\", "\\\\[INST]\\", "<s><s>[/INST]", "", None, "plain\nlines\n"]
    rows = [(-7, i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(posed * 2)]
    rows += [(1, 0, "system", "be kind " * 20)] + [(1, i, "user" if i % 2 else "assistant", f"{i} " + "word " * (i % 90)) for i in range(1, 120)]
    rows += [(2, 0, "assistant", "x " * 5000), (2, 0, "assistant", "x " * 5000), (2, 1, None, "y"), (3, 0, "tool [INST]\n", "</s>"), (None, 0, "user", "no id")]
    t = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(t).collect()}
    assert got == brute_chat(rows)
    w = chat.windows(t).where("conv_id = 1").orderBy("window").collect()
    assert len(w) > 3 and all(x.formatted.startswith("<s>[INST]system") for x in w) and all(x.repeated > 1 for x in w[1:])
    assert all(len(re.findall(r"\w+|[^\w\s]", x.formatted)) <= chat.BUDGET * 1.4 for x in w)
    assert chat.digest(t.limit(0)).count() == 0


# 10 toxicity

def test_toxicity(spark):
    r = random.Random(4)
    texts, labels = [], []
    for i in range(700):
        w = prose(i, 60).split()
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["grobble", "snarfish", "idiot"])
        texts.append(" ".join(w))
        labels.append((i, int(toxic), 0))
    d = docs(spark, texts + ODD)
    lab = spark.createDataFrame(labels + labels[:5] + [(None, 1, 0), (3_000_000, None, 0)], "doc_id long, toxic int, quality int")
    got = {x.doc_id: x for x in toxicity.score(d, lab).collect()}
    held = [i for i, *_ in labels if got[i].held_out]
    assert len(held) > 90 and np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    assert all(0 <= x.score <= 1 for x in got.values()) and len(got) == len(texts) + len(ODD)
    kept = toxicity.keep(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(1 - x.predicted for x in got.values())
    assert {x.score for x in toxicity.score(d, lab.limit(0)).collect()} == {0.0}
    assert toxicity.score(d.limit(0), lab).count() == 0
    brier = np.mean([(got[i].score - labels[i][1]) ** 2 for i in held])
    assert brier < 0.05
    twice = toxicity.fit(d.unionByName(d), lab)
    assert np.allclose(twice.score(texts[:50]), [got[i].score for i in range(50)])
    flipped = lab.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x.doc_id: x.score for x in toxicity.score(d, flipped).collect()} == {i: x.score for i, x in got.items()}


def test_disguised_words_count():
    lexicon = toxicity.Lexicon({"grobble": 1.0})
    at = toxicity.NAMES.index("disguised")
    for text in ("you gr0bble", "you gr@bble".replace("@", "0"), "you grobbble", "you i d i o t !", "an id!ot here"):
        assert toxicity.features(text, lexicon)[at] > 0, text
    assert toxicity.features("you are a fine person 4 you", lexicon)[at] == 0


def test_isotonic_never_falls():
    s = np.random.default_rng(1).normal(size=300)
    knots, levels = boosting.isotonic(s, (s + np.random.default_rng(2).normal(size=300) > 0).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= 0).all()


# the pipeline

def test_pipeline_keeps_what_each_stage_keeps(spark, tmp_path):
    """run() against the stages' plain versions, on a small table with every odd case."""
    import corpus_pipeline as pipe

    r, insults = random.Random(7), ["grobble", "snarfish", "idiot"]
    texts, toxic = [], []
    for i in range(300):
        w = prose(i, 60).split()
        toxic.append(r.random() < 0.3)
        for _ in range(4 * toxic[-1]):
            w[r.randrange(60)] = r.choice(insults)
        texts.append(" ".join(w))
    item, line = prose(900, 30), "this line is shared by many documents and long enough to count"
    base = prose(901, 120).split()
    texts += [f"{prose(1000 + i, 30)}\n{line}" for i in range(7)] + [" ".join(base), " ".join(w if i != 50 else "new" for i, w in enumerate(base)), " ".join(base)]
    texts += [f"{prose(1100, 20)} {item}", None, "", "\n\n"] + [t for t in ODD if t]
    rows = [(i, t, "en", None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "a text without an id", "en", "s", 5)]
    folder = str(tmp_path)
    write = lambda data, kind, name: spark.createDataFrame(data, kind).write.parquet(f"{folder}/{name}.parquet")
    write(rows, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write([(i, int(toxic[i]), 1) for i in range(300)], "doc_id long, toxic int, quality int", "labels")
    write([("b", item), (None, None)], "item_id string, text string", "benchmark")
    got = pipe.run(spark, folder).collect()

    docs_ = spark.read.parquet(f"{folder}/documents.parquet")
    bad = {x.doc_id for x in toxicity.score(docs_, spark.read.parquet(f"{folder}/labels.parquet")).collect() if x.predicted}
    assert np.mean([(i in bad) == toxic[i] for i in range(300)]) > 0.97
    kept = [(i, t) for i, t, *_ in rows if i not in bad]
    who = {}
    for i, t in kept:
        for x in (t or "").split("\n"):
            if i is not None and len(x.strip(" \t\n\x0b\x0c\r")) >= 40:
                who.setdefault(x.strip(" \t\n\x0b\x0c\r").lower(), set()).add(i)
    drop = {k: max(v) for k, v in who.items() if len(v) >= 5}
    clean = {(i, "\n".join(x for x in (t or "").split("\n") if i is None or drop.get(x.strip(" \t\n\x0b\x0c\r").lower(), i) == i)) for i, t in kept}
    named = sorted((x for x in clean if x[0] is not None), key=lambda x: x[0])
    words_ = {i: omh.numbers(omh.words(t)) for i, t in named}
    least = {}
    for i, _ in named:
        alike = [least[j] for j in least if len(words_[i]) and len(words_[j]) and omh.similarity(words_[i], words_[j]) >= 0.8]
        least[i] = min(alike, default=i)
    left = [(i, t) for i, t in named if least[i] == i] + [x for x in clean if x[0] is None]
    left = [(i, t) for i, t in left if not brute_leaks(t, [("b", item)])[4]]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in left:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t)))
    order = lambda x: (x[0] is None, x)
    assert sorted(((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got), key=order) == sorted(want, key=order)
