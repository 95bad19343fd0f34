"""Spelling variants of a vocabulary by finite-state composition.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. The pairs are those that the
composition of the vocabulary's minimised acceptor, a transducer that makes one edit, and the acceptor again accepts. Until
the edit both acceptors are in the same state, so a pair belongs to the one state where its words part.

* The composition is enumerated by initial state, the state after a common beginning. Beginnings are prolonged until at most
  ``GROUP`` words continue from them; each such set of words is built as an acceptor of its own in some task.
* Words that part inside a prolonged beginning, right behind its first code points p, are p c s and p d s, or p s and p c s.
  They meet in a join on (p, s), whose groups hold at most one word per code point and one more.

Words part in one place only, so no pair comes twice; no group grows with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flickpulse.operators.scale import stage

GROUP = 2_000
STRIDE = 8
RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAIRS = "a string, n_a long, b string, n_b long"


class Acceptor:
    """The minimal deterministic acceptor of a sorted list of distinct words; state 0 is the initial one."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        register: dict[tuple, int] = {}
        path: list[int] = [0]  # states along the word added last
        last = ""

        def settle(keep: int) -> None:
            """Replace the states behind ``keep`` code points of the last word by registered equals."""
            for i in range(len(path) - 1, keep, -1):
                state = path.pop()
                shape = (self.final[state], *self.arcs[state].items())
                self.arcs[path[-1]][last[i - 1]] = register.setdefault(shape, state)

        for word in words:
            same = 0
            for x, y in zip(word, last):
                if x != y:
                    break
                same += 1
            settle(same)
            for c in word[same:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][c] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = word
        settle(0)


def _spelt(link: tuple | None) -> str:
    """The code points of a linked path."""
    out = []
    while link is not None:
        link, c = link
        out.append(c)
    return "".join(reversed(out))


class OneEdit:
    """The acceptor composed with the one-edit transducer and itself."""

    def __init__(self, acceptor: Acceptor):
        self.arcs, self.final = acceptor.arcs, acceptor.final
        self.meets: dict[tuple[int, int], bool] = {}

    def _meet(self, x: int, y: int) -> bool:
        """Whether some ending is accepted from both states."""
        if x == y:
            return True
        stack = [(x, y) if x < y else (y, x)]
        while stack:
            at = stack[-1]
            if at in self.meets:
                stack.pop()
                continue
            p, q = self.arcs[at[0]], self.arcs[at[1]]
            known, wait = self.final[at[0]] and self.final[at[1]], []
            if not known:
                for c in (p if len(p) <= len(q) else q):
                    if c in p and c in q:
                        s, t = p[c], q[c]
                        both = (s, t) if s < t else (t, s)
                        if s == t or self.meets.get(both):
                            known = True
                            break
                        if both not in self.meets:
                            wait.append(both)
            if known or not wait:
                self.meets[at] = known
                stack.pop()
            else:
                stack.append(wait[-1])
        return self.meets[(x, y) if x < y else (y, x)]

    def _common(self, x: int, y: int, link: tuple | None) -> Iterator[tuple | None]:
        """Endings accepted from both states, as linked paths after ``link``."""
        stack = [(x, y, link)]
        while stack:
            x, y, link = stack.pop()
            if not self._meet(x, y):
                continue
            if self.final[x] and self.final[y]:
                yield link
            for c, s in self.arcs[x].items():
                t = self.arcs[y].get(c)
                if t is not None:
                    stack.append((s, t, (link, c)))

    def _edits(self, state: int) -> list[tuple[str, str]]:
        """Ending pairs of words that part in this state."""
        out, arcs = [], list(self.arcs[state].items())
        for i, (c, s) in enumerate(arcs):
            for d, t in arcs[:i]:
                if self._meet(s, t):
                    for end in map(_spelt, self._common(s, t, None)):
                        out.append((c + end, d + end))
            # c inserted before an ending that does not begin with c, else the words would part later
            if self.final[state] and self.final[s]:
                out.append((c, ""))
            for d, t in arcs:
                u = self.arcs[s].get(d)
                if d != c and u is not None:
                    for end in map(_spelt, self._common(u, t, (None, d))):
                        out.append((c + end, end))
        return out

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs of accepted words that are one edit apart, each once."""
        edits: dict[int, list[tuple[str, str]]] = {}
        stack: list[tuple[int, tuple | None]] = [(0, None)]
        while stack:
            state, link = stack.pop()
            if state not in edits:
                edits[state] = self._edits(state)
            if edits[state]:
                begin = _spelt(link)
                for x, y in edits[state]:
                    yield begin + x, begin + y
            stack.extend((s, (link, c)) for c, s in self.arcs[state].items())


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs inside each group of ``g, depth, word, n`` rows that are sorted by group and word."""
    def solve(begin: str, ends: list[str], counts: list[int]) -> pa.RecordBatch:
        n, out = dict(zip(ends, counts)), []
        if len(ends) > 1:
            out = [(begin + x, n[x], begin + y, n[y]) for x, y in OneEdit(Acceptor(ends)).pairs()]
        a, n_a, b, n_b = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n_a, pa.int64()), pa.array(b, pa.string()),
                                           pa.array(n_b, pa.int64())], names=["a", "n_a", "b", "n_b"])

    group, ends, counts = None, [], []
    for batch in batches:
        for g, depth, word, n in zip(*(batch.column(c).to_pylist() for c in ("g", "depth", "word", "n"))):
            if g != group:
                if group is not None:
                    yield solve(group, ends, counts)
                group, ends, counts = g, [], []
            ends.append(word[depth:])
            counts.append(n)
    if group is not None:
        yield solve(group, ends, counts)


def _begin(depth: Column | str) -> Column:
    return F.substring("word", F.lit(1), F.col(depth) if isinstance(depth, str) else depth)


def _beginnings(vocabulary: DataFrame, group: int) -> DataFrame:
    """``word, n, depth``: the shortest beginning of each word from which at most ``group`` words go on.

    Only beginnings of ``STRIDE`` more code points are counted at a time, and only for words that need them.
    """
    rest, found, low = vocabulary, None, 0
    while True:
        each = rest.select("word", F.explode(F.sequence(F.lit(low), F.lit(low + STRIDE - 1))).alias("depth")).withColumn("g", _begin("depth"))
        # a beginning of such a one has as many words or more, so the depth is the number of those that are too wide
        wide = stage(each.groupBy("g", "depth").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") > group).select("g", "depth"))
        depth = each.join(wide, ["g", "depth"]).groupBy("word").agg(F.count(F.lit(1)).alias("more"))
        more = F.coalesce("more", F.lit(0))
        depth = stage(rest.join(depth, "word", "left").select("word", "n", (more + low).cast("int").alias("depth"), (more == STRIDE).alias("on")))
        placed = depth.filter("not on").select("word", "n", "depth")
        found = placed if found is None else found.unionByName(placed)
        rest, low = depth.filter("on").select("word", "n"), low + STRIDE
        if rest.isEmpty():
            return found


def near_pairs(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of distinct near words of ``vocabulary`` (distinct ``word``, and ``n``), once.

    Defined cases: null words are left out, the empty word is near to words of one code point. An empty table gives no pairs.
    """
    tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = _beginnings(vocabulary.select("word", F.col("n").cast("long")).filter("word is not null"), group)
    inside = (words.withColumn("g", _begin("depth")).repartition(tasks, "g").sortWithinPartitions("g", "word")
              .select("g", "depth", "word", "n").mapInArrow(_enumerate, PAIRS))
    # words that part behind the first ``at`` code points of a beginning that was prolonged
    parting = words.filter("depth > 0").select("word", "n", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("at"))
    parting = parting.filter(F.char_length("word") >= F.col("at"))
    rest = F.substring("word", F.col("at") + 1, F.char_length("word"))
    less = F.substring("word", F.col("at") + 2, F.char_length("word"))
    key = [F.col("at"), _begin("at").alias("p")]
    cut = parting.filter(F.char_length("word") > F.col("at")).select(
        *key, less.alias("s"), F.substring("word", F.col("at") + 1, F.lit(1)).alias("c"), "word", "n")
    whole = parting.select(*key, rest.alias("s"), F.lit("").alias("c"), "word", "n")
    x = cut.select("at", "p", "s", "c", F.col("word").alias("a"), F.col("n").alias("n_a"))
    y = cut.unionByName(whole).select("at", "p", "s", F.col("c").alias("d"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    replaced = (F.col("d") != "") & (F.col("c") < F.col("d"))
    inserted = (F.col("d") == "") & ~F.startswith(F.col("s"), F.col("c"))
    across = x.join(y, ["at", "p", "s"]).filter(replaced | inserted).select("a", "n_a", "b", "n_b")
    return inside.unionByName(across)


def variants(vocabulary: DataFrame, ratio: int = 2, group: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``vocabulary`` (``word``, ``n``).

    ``form`` is the near word of largest ``n`` (ties: smallest in code-point order) if that ``n`` is ``ratio`` times the word's
    own at least; ``root`` is where the forms lead. Defined cases: null words are left out; rows that repeat a word are one
    word, their ``n`` add up, a null ``n`` is 0; other columns are not read. An empty table gives an empty result.
    """
    words = stage(vocabulary.filter("word is not null").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")))
    pairs = stage(near_pairs(words, group))
    near = pairs.unionByName(pairs.toDF("b", "n_b", "a", "n_a"))
    best = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("m"), "b")).alias("top"))
    fits = (-F.col("top.m") >= ratio * F.col("n")) & (-F.col("top.m") > F.col("n"))
    judged = stage(words.join(best, words.word == best.a, "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("top.b")).alias("form"),
        F.when(fits, -F.col("top.m")).alias("form_n")))
    # each round doubles how far a word is led; n grows at every step, so there are no circles
    lead = judged.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = lead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        lead = stage(lead.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("led")))
        if lead.filter("led").isEmpty():
            break
        lead = lead.select("word", "root")
    return judged.join(lead.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs(docs: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """The columns of ``docs`` but the text, and ``run_``: each maximal run of letters of at least ``least`` code points,
    A-Z lower-cased. A null text has none."""
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    pattern = F.lit(RUN.replace("+", "{%d,}" % least))
    return docs.select(*[c for c in docs.columns if c != text_col], F.explode(F.regexp_extract_all(lower, pattern, F.lit(0))).alias("run_"))
