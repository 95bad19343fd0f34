"""Fingerprints, spelling variants and lexical search against brute force, and on the cases their docstrings define."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flickpulse.llm import fingerprints, lexical, spelling

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- fingerprints --------------------------------------------------------------------------------------------------
ODD = ["", "a", "ab", "abc", "\n", "\n\n", "a\nb", "b\na", "x" * 5000, "é\n" * 40, "hello world this is\nshort", "q" * 31, "q" * 32,
       "zz\n" + "w" * 1_500_000, "\r\n", "line\nline\nline", "😀" * 9]


def same(a, b):
    return (a.equal == b.equal).all() and (a.like == b.like).all()


def test_sums_are_those_of_the_paragraphs():
    whole = fingerprints.sums([t.encode() for t in ODD])
    for i, t in enumerate(ODD):
        parts = fingerprints.sums([p.encode() for p in t.split("\n")])
        total = fingerprints.Sums(parts.equal.sum(0, keepdims=True), parts.like.sum(0, keepdims=True).astype(np.uint32))
        assert same(whole[[i]], total) and same(whole[[i]], fingerprints.sums([t.encode()])), t[:20]
    multisets = [tuple(sorted(t.split("\n"))) for t in ODD]
    packed = whole.packed()
    assert all((packed[i] == packed[j]) == (multisets[i] == multisets[j]) for i in range(len(ODD)) for j in range(i))
    assert same(fingerprints.unpacked(packed), whole) and same(fingerprints.sums([None]), fingerprints.zeros(1))
    changed = fingerprints.updated(fingerprints.sums([b"a\nb\nc"]).packed()[0], ["d", "d"], ["b"])
    assert changed == fingerprints.sums([b"d\na\nc\nd"]).packed()[0]


def test_likeness_follows_what_is_common():
    rng = np.random.default_rng(1)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 12))
    own = [line() for _ in range(60)]
    texts = ["\n".join(own[:n] + [line() for _ in range(60 - n)]) for n in (60, 54, 45, 30, 15, 0)]
    made = fingerprints.sums([t.encode() for t in texts])
    near = fingerprints.likeness(made[[0] * 6], made)
    assert near[0] == 1 and (np.diff(near) < 0).all() and np.allclose(near, [1, .9, .75, .5, .25, 0], atol=0.2)
    repeated = fingerprints.sums(["\n".join(own + ["again and again"] * n).encode() for n in (0, 300)])
    assert fingerprints.likeness(repeated[[0]], repeated[[1]])[0] > 0.5  # one line repeated 300 times does not outweigh the rest


def by_plain_python(rows):
    """Descending ids; the rows of one id by text."""
    out = {}
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out.setdefault(i, []).append((len(t), t, t[:len(t) - half] + n[:half], n))
    return out


@pytest.mark.parametrize("partitions", ["3", "8", "60"])
def test_edited_fingerprints(spark, partitions):
    rng = random.Random(4)
    rows = [(i * 7 - 300, "".join(rng.choice("ab é\n😀") for _ in range(rng.choice([0, 1, 2, 9, 60, 300])))) for i in range(150)]
    rows += [(10_000, None), (-(2 ** 63), "least"), (2 ** 63 - 1, "most\nof all")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_chars int, range_ string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fingerprints.edited_fingerprints(df).collect()
        again = {r.doc_id: r.fingerprint_ for r in fingerprints.fingerprints(df).collect()}
        one = fingerprints.edited_fingerprints(df.filter("doc_id = 1")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = by_plain_python(sorted(((i, t or "") for i, t in rows), reverse=True))
    assert len(got) == len(rows)
    for r in got:
        (n, own, edited, following), = want[r.doc_id]
        a, b, c = fingerprints.sums([own.encode()]), fingerprints.sums([edited.encode()]), fingerprints.sums([following.encode()])
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint_ == a.packed()[0] == again[r.doc_id] and r.edited_fingerprint_ == b.packed()[0]
        assert r.near_edited == fingerprints.likeness(a, b)[0] and r.near_next == fingerprints.likeness(a, c)[0]
    (r,) = one
    assert r.near_next == 1.0 and r.doc_id == 1


def test_edited_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(1, "one\ntwo"), (1, "one\ntwo"), (1, "three"), (None, "none"), (None, None), (2, ""), (2, ""), (0, "zero " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.edited_fingerprints(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert Counter(r.n_chars for r in got) == Counter(len(t or "") for _, t in rows)
    assert len({r.fingerprint_ for r in got if r.n_chars == 7}) == 1
    twice = [r for r in got if r.doc_id == 2]
    assert sorted(r.near_next == 1.0 for r in twice) == [False, True] and all(r.near_edited == 1.0 for r in twice)
    assert fingerprints.edited_fingerprints(df.limit(0)).count() == 0 and fingerprints.fingerprints(df.limit(0)).count() == 0


def test_apply_edits(spark):
    texts = {1: "a\nb\nb", 2: "x", 3: ""}
    prints = fingerprints.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    edits = [(1, "b", -1), (1, "c", 2), (1, "a", -1), (2, "y", 1), (9, "z", 1), (None, "z", 1), (2, None, 1), (2, "q", None)] + [(3, "hot", 1)] * 500
    after = fingerprints.apply_edits(prints, spark.createDataFrame(edits, "doc_id long, paragraph string, times int").repartition(6)).collect()
    want = {1: "b\nc\nc", 2: "x\ny", 3: "\n".join([""] + ["hot"] * 500)}
    assert {r.doc_id: r.fingerprint_ for r in after} == {i: fingerprints.sums([t.encode()]).packed()[0] for i, t in want.items()}
    assert after[0].asDict().keys() == {"doc_id", "text", "fingerprint_"}
    one = prints.withColumn("one", F.lit(1))
    pairs = one.join(one.select("one", F.col("fingerprint_").alias("other"), F.col("doc_id").alias("o")), "one").select(
        "doc_id", "o", fingerprints.likeness_of("fingerprint_", "other").alias("l"), fingerprints.likeness_of("fingerprint_", F.lit(None).cast("binary")).alias("n"))
    assert all((r.l == 1.0) == (r.doc_id == r.o) and r.n is None for r in pairs.collect())


def test_op11_tells_edited_texts_from_others(spark):
    got = corpus_pipeline.QUERIES["op11_document_fingerprints"](spark, SF).toPandas()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = by_plain_python(sorted(texts.items(), reverse=True))
    assert all(r.edited_sha256 == hashlib.sha256(want[r.doc_id][0][2].encode()).hexdigest() for r in got.itertuples())
    long = got[got.n_chars >= 40]
    assert (long.near_edited > long.near_next).mean() > 0.99 and got.fingerprint.nunique() == len({tuple(sorted(t.split("\n"))) for t in texts.values()})


# ---- spelling ------------------------------------------------------------------------------------------------------
def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_composition_of_small_vocabularies():
    rng = random.Random(5)
    for letters in ("a", "ab", "abé", "abcdef"):
        for _ in range(60):
            words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 50))})
            got = list(spelling.OneEdit(spelling.Acceptor(words)).pairs())
            assert len(got) == len({frozenset(p) for p in got}), "a pair came twice"
            assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    long = ["x" * 30_000 + "a", "x" * 30_000 + "b", "x" * 30_000]
    assert len(list(spelling.OneEdit(spelling.Acceptor(sorted(long))).pairs())) == 3


def test_the_acceptor_is_minimal():
    words = sorted(a + b + c for a in ("", "un") for b in ("do", "lock", "tie") for c in ("", "s", "ing"))
    made = spelling.Acceptor(words)
    reached, todo = {0}, [0]
    while todo:
        for s in made.arcs[todo.pop()].values():
            if s not in reached:
                reached.add(s)
                todo.append(s)

    def language(state):
        return frozenset(({""} if made.final[state] else set()) | {c + w for c, s in made.arcs[state].items() for w in language(s)})

    assert language(0) == set(words) and len({language(s) for s in reached}) == len(reached)


@pytest.mark.parametrize("group", [1, 4, 40, 5000])
def test_near_pairs_and_forms(spark, group):
    rng = random.Random(group)
    words = {}
    for _ in range(700):
        words["aaaaaaaaaa"[:rng.choice([0, 0, 10])] + "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))] = rng.randint(1, 60)
    words |= {"": 3, "Z": 8, "ÿ" * 40: 1, "ÿ" * 41: 2, "ÿ" * 42: 4, "ÿ" * 43: 8}
    df = spark.createDataFrame([(w, n, 1, "g") for w, n in words.items()], "word string, n int, depth int, g string").repartition(5)
    pairs = [(r.a, r.n_a, r.b, r.n_b) for r in spelling.near_pairs(df, group).collect()]
    assert len(pairs) == len({frozenset((a, b)) for a, _, b, _ in pairs}) and all(words[a] == n and words[b] == m for a, n, b, m in pairs)
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    assert {frozenset((a, b)) for a, _, b, _ in pairs} == {frozenset((w, v)) for w in words for v in near[w]}
    got = spelling.variants(df, group=group).collect()
    form = {w: min(v, key=lambda x: (-words[x], x)) if v else None for w, v in near.items()}
    form = {w: f if f is not None and words[f] >= 2 * words[w] else None for w, f in form.items()}
    assert len(got) == len(words)
    for r in got:
        root = r.word
        while form[root] is not None:
            root = form[root]
        assert (r.form, r.root, r.n, r.n_near) == (form[r.word], root, words[r.word], len(near[r.word])), r
        assert r.form_n == (words[r.form] if r.form is not None else None)


def test_spelling_cases(spark):
    rows = [("word", 4), ("word", 6), ("words", None), (None, 9), ("ward", 25)]
    got = {r.word: (r.form, r.root, r.n, r.n_near) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {"word": ("ward", "ward", 10, 2), "words": ("word", "ward", 0, 1), "ward": (None, "ward", 25, 1)}
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(none).count() == 0 and spelling.near_pairs(none).count() == 0
    texts = [(1, "Éa Ab-cÿ×3x"), (2, None), (3, ""), (None, "q" * 70_000), (1, "A_B")]
    found = spelling.runs(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.run_) for r in found) == Counter(
        [(1, "Éa"), (1, "ab"), (1, "cÿ×"), (1, "x"), (None, "q" * 70_000), (1, "a"), (1, "b")])


# ---- lexical search ------------------------------------------------------------------------------------------------
def ranked(docs, queries, k=10):
    texts, asked = {}, {}
    for into, rows in ((texts, docs), (asked, queries)):
        for i, t in rows:
            if i is not None:
                into.setdefault(i, []).extend(TERM.findall((t or "").translate(A_Z)))
    texts = {i: Counter(t) for i, t in texts.items() if t}
    total, df = sum(sum(c.values()) for c in texts.values()), Counter(t for c in texts.values() for t in c)
    out = []
    for q, terms in asked.items():
        scores = {}
        for i, c in texts.items():
            m = 10 + (90 * sum(c.values()) * len(texts)) // total
            s = sum(math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(terms) if t in c)
            if s > 0:
                scores[i] = s
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r, i, s) for r, (i, s) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_lexical_search(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Äß", "x1", "the", "The"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: ", ".join(rng.choices(words, weights, k=n))
    docs = [(i - 100, text(rng.choice([1, 2, 5, 30, 200]))) for i in range(700)]
    docs += [(2000 + i, "same text the w1 w50") for i in range(300)]  # ties, a hot group
    docs += [(5, "more w3 of it"), (5, "more w3 of it"), (None, "w1 w2"), (3000, None), (3001, ""), (3002, " -- \n"), (3003, "w59 " * 20_000)]
    queries = [(i, text(n)) for i, n in enumerate([1, 2, 3, 8, 20, 60])]
    queries += [(50, None), (51, "unknown"), (52, "same THE w50"), (None, "w1"), (53, "w1"), (53, "w2 w2"), (54, "it")]
    df = spark.createDataFrame([(i, t, 1, "s", 0) for i, t in docs], "doc_id long, text string, n int, s string, rank int").repartition(9)
    asked = spark.createDataFrame([(i, t, 1.0) for i, t in queries], "item_id long, text string, score double")
    for k in (1, 10, 2000):
        got = lexical.search(df, asked, k).collect()
        assert sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in got) == ranked(docs, queries, k)
    assert lexical.search(df.limit(0), asked).count() == 0 and lexical.search(df, asked.limit(0)).count() == 0
