"""Every pipeline stage against plain Python on that stage's own input, spread over many partitions."""

import re
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flickpulse.llm import catalog

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGE = dict(corpus_pipeline.STAGES)


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def start(spark):
    """The smallest table, with copies and near copies of some of its documents, and passages that some hold twice."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    long = [r for r in rows if len(words(r[1])) > 120][:12]
    passage = " ".join(words(long[0][1])[20:50])
    for i, (_, text, lang, source, _) in enumerate(long):
        w = words(text)
        w[len(w) // 2] = "exchanged"
        twice = f"{passage} first {i} {passage} second {i}\n{text[::-1]}"
        rows += [(10_000 + i, text, lang, source, len(text)), (20_000 + i, " ".join(w), lang, source, None), (30_000 + i, twice, lang, source, len(twice))]
    rows += [(40_000, None, "en", "s", None), (40_001, "", "en", "s", 0), (40_002, "\n \n", "en", "s", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(16, "doc_id")


@pytest.fixture(scope="module")
def inputs(spark, start):
    """What each stage gets: all its predecessor kept, again in many partitions."""
    out, now = {}, start
    for name, step in corpus_pipeline.STAGES:
        out[name] = now
        now = corpus_pipeline.stage(step(spark, now, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            now = now.repartition(16, "doc_id")
    return out, now


def kept(spark, inputs, name):
    """The texts a stage gets, and those it returns."""
    before, names = inputs[0][name], [n for n, _ in corpus_pipeline.STAGES]
    after = inputs[0][names[names.index(name) + 1]]
    return {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}


def test_quality(spark, inputs):
    before, after = kept(spark, inputs, "quality rules")
    passed = set()
    for i, t in before.items():
        w = words(t)
        seen, again = {}, set()
        for j in range(len(w) - 7):
            seen.setdefault(tuple(w[j:j + 8]), []).append(j)
        for places in seen.values():
            if len(places) > 1:
                again |= {j + d for j in places for d in range(8)}
        if len(w) >= 20 and 100 * len(again) <= 30 * len(w):
            passed.add(i)
    assert set(after) <= passed and len(after) > 0.7 * len(passed) and all(before[i] == t for i, t in after.items())


def one_word(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_lines(spark, inputs):
    before, after = kept(spark, inputs, "line dedup")
    first, want = {}, {}
    places = [(i, k, line, tuple(words(line.lower()))) for i in sorted(before) for k, line in enumerate(before[i].split("\n"))]
    for i, k, _, w in places:
        first.setdefault(w, (i, k))
    by_start = {}
    for w in first:
        if len(w) >= 8:
            for part in (("a", w[:4]), ("z", w[-4:])):  # an edit leaves one end as it was
                by_start.setdefault(part, []).append(w)
    near = {w for w in first if len(w) >= 8 and any(
        v != w and first[v] < first[w] and one_word(v, w) for part in (("a", w[:4]), ("z", w[-4:])) for v in by_start[part])}
    for i, k, line, w in places:
        if not w or (first[w] == (i, k) and w not in near):
            want.setdefault(i, []).append(line)
    want = {i: "\n".join(want.get(i, [])) for i in before}
    want = {i: t for i, t in want.items() if words(t) or not words(before[i])}
    assert after == want and any(i >= 10_000 for i in before) and not {i for i in after if 10_000 <= i < 20_000}


def test_near_duplicates(spark, inputs):
    before, after = kept(spark, inputs, "minhash near-dedup")
    sets = {}
    for i, t in before.items():
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    assert set(after) == {i for i in sets if find(i) == i} and all(before[i] == t for i, t in after.items())


def test_substrings(spark, inputs):
    before, names = inputs[0]["substring dedup"], corpus_pipeline.COLUMNS
    texts = {r.doc_id: r.text for r in before.select(*names).collect()}
    after = {r.doc_id: r.text for r in inputs[0]["best-fit packing"].collect()}
    first = {}
    for i in sorted(texts):
        w = words(texts[i])
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j:j + 13]), i)
    assert set(after) == set(texts)
    cut = 0
    for i, t in texts.items():
        w = words(t)
        gone = {j + d for j in range(len(w) - 12) if first[tuple(w[j:j + 13])] < i for d in range(13)}
        assert words(after[i]) == [x for j, x in enumerate(w) if j not in gone], i
        assert gone or after[i] == t
        cut += bool(gone)
    assert cut >= 5


def test_packing(inputs):
    packed = inputs[1].collect()
    tokenizer = Tokenizer.from_file(catalog.word_bpe())
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in inputs[0]["best-fit packing"].collect()}
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, rows in by_doc.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and [r.start for r in rows] == [4096 * k for k in range(len(rows))]
        assert [r.length for r in rows] == [len(ids[i][s:s + 4096]) for s in range(0, len(ids[i]), 4096)]
        for r in rows:
            part = ids[i][r.start:r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    total = 0
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) <= 4096
        total += sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 4096) * 1.1 + 1
