"""Line index, hard negatives and periodic runs against plain definitions."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from speccurve.llm import hard_negatives, line_index, periodic, queries
from speccurve.llm.common import shared_folder

import brute

# -- periodic runs ----------------------------------------------------------------------------


def plain_runs(words, least_words=6, least_periods=4):
    """All maximal runs, by comparing the words with themselves for every period."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([number[w] for w in words], np.int64)
    found = []
    for q in range(1, len(x) // least_periods + 1):
        same = np.r_[False, x[q:] == x[:-q], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = hi - lo + q
            if length >= max(least_words, least_periods * q):
                inner = [p for s, n, p in found if s <= lo and s + n >= lo + length and q % p == 0]
                if not inner:
                    found.append((lo, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


RUN_TEXTS = [
    None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "A a A a A a A a",
    "x y z " * 4, "b x y z x y z x y z x y c", "u " + "a b a c " * 9 + "a b v v v v v v v",
    "a b " * 6, "é ß é ß é ß é ß é", "p q " * 3 + "p q r " * 5 + "s",
    "w " * 4000 + " ".join(f"k{i}" for i in range(2000)), ("m " * 5 + "n ") * 40,
]


@pytest.fixture(scope="module")
def run_docs(spark):
    rows = [(i, t, "x", [i]) for i, t in enumerate(RUN_TEXTS)] + [(3, "a", "y", None)]
    rows += [(None, "q q q q q q", "z", [])]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, text2 array<int>")


def test_runs_of_made_texts(run_docs):
    rows = periodic.periodic_runs(run_docs, keep=("runs", "text2")).toDF(
        "doc_id", "kept", "text2", "runs", "collapsed"
    ).collect()
    assert len(rows) == len(RUN_TEXTS) + 2
    for r in rows:
        text = "q q q q q q" if r["doc_id"] is None else RUN_TEXTS[r["doc_id"]]
        words = brute.words(text)
        want = plain_runs(words)
        assert [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == collapsed(words, want)


def test_runs_of_random_words():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 70))
        x = rng.integers(0, 2, n)
        at, q = int(rng.integers(0, n)), int(rng.integers(1, 9))
        x[at : at + 5 * q] = np.resize(x[at : at + q], len(x[at : at + 5 * q]))
        for least in (3, 4):
            got = periodic.find_runs(x.astype(np.int64), np.full(n, n), 6, least)
            assert [tuple(r) for r in got.tolist()] == plain_runs(x.tolist(), 6, least)


def test_runs_of_the_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in
            spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op13_basic_factors(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        w = brute.words(docs[r["doc_id"]])
        h = zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r["collapsed_sha256"] == sha(collapsed(w, runs))


def test_runs_of_nothing_and_of_a_very_long_text(spark, run_docs):
    assert periodic.periodic_runs(run_docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(run_docs, least_periods=2)
    long = spark.range(1).select(
        F.lit(1).alias("doc_id"), F.concat(F.expr("repeat('ab cd ef ', 600000)"), F.lit("gh"))
        .alias("text"),
    )
    row = periodic.periodic_runs(long).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 1_800_000, 3)]
    assert row["collapsed"] == "ab cd ef gh"


# -- hard negatives ---------------------------------------------------------------------------


def plain_negatives(rows, anchors, positives=5, negatives=3):
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    for a in (r for r in rows if r[0] in anchors):
        others = [(score(a, b), b) for b in rows if b[0] != a[0] and len(b[2]) == len(a[2])]
        others.sort(key=lambda x: (-x[0], x[1][0]))
        for p, b in [x for x in others if x[1][1] == a[1]][:positives]:
            fits = [x for x in others if x[1][1] != a[1] and 50 * p <= 100 * x[0] <= 95 * p]
            out += [(a[0], b[0], i + 1, c[0], p, s) for i, (s, c) in enumerate(fits[:negatives])]
    return sorted(out)


VECTORS = "vec_id long, label int, v array<long>, rank int, anchor_id string, s double"


def made(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 0.5) for r in rows], VECTORS).repartition(3)


def got(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("dims", [1, 3, 16, 50])
def test_negatives(spark, monkeypatch, dims):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(dims)
    centre = rng.integers(-40, 40, (3, dims))
    rows = []
    for i in range(150):
        label = 0 if i % 3 == 0 else int(rng.integers(0, 3))
        v = centre[label] + centre[0] + rng.integers(-30, 30, dims)
        rows.append((i, label, v.tolist()))
    rows += [(200 + i, i % 2, rows[0][2]) for i in range(60)]  # one very common vector
    rows += [(300, 1, [0] * dims), rows[7], rows[7]]
    want = plain_negatives(rows, set(range(0, 301, 50)))
    assert want
    df = made(spark, rows)
    assert got(hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0)) == want


def test_negatives_of_odd_rows(spark):
    big = 1 << 30
    rows = [
        (0, 1, [3, 4]), (1, 1, [6, 8]), (2, 2, [4, 4]), (3, 2, [5]), (4, 1, []), (5, 2, []),
        (6, 1, []), (7, 3, [big, big]), (8, 3, [big + 1, big]), (9, 4, [big - (big >> 3), big]),
    ]
    want = plain_negatives(rows, {0, 4, 7})
    rows += [(None, 1, [1, 2]), (10, None, [1, 2]), (11, 1, None), (12, 2, [None, 5])]
    found = hard_negatives.hard_negatives(made(spark, rows), F.col("vec_id").isin(0, 4, 7))
    assert got(found) == want and len({w[0] for w in want}) == 3
    nothing = made(spark, rows).where("false")
    assert hard_negatives.hard_negatives(nothing, F.col("vec_id") == 0).count() == 0


def test_bounds_hold(spark):
    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.normal(size=(60, 64)) + rng.normal(size=(60, 1)) * 300)
    parts = hard_negatives.summaries(v)
    exact, lo, reach = v @ v.T, 0, []
    for bounds in hard_negatives.segment_bounds(64):
        k = len(bounds) - 1
        mean, spread = parts[:, lo : lo + k], parts[:, lo + k : lo + 2 * k]
        assert (np.abs(exact - mean @ mean.T) <= spread @ spread.T + 1e-6).all()
        reach.append((spread @ spread.T).mean())
        lo += 2 * k
    assert len(reach) == 3 and reach[0] > reach[1] > reach[2]


# -- lines ------------------------------------------------------------------------------------


def test_filter_forgets_what_is_deleted(monkeypatch):
    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(-(2**63), 2**63 - 1, (2, 4000))
    monkeypatch.setattr(line_index, "BUCKETS", 1 << 10)
    made = line_index.CuckooFilter()
    made.insert(k1[:2500], k2[:2500])
    made.insert(k1[2500:], k2[2500:])
    assert made.contains(k1, k2).all() and len(made.stash)  # 98 % of the slots
    made = line_index.CuckooFilter(made.slots.tobytes(), made.stash.tobytes())
    made.delete(k1[:3000], k2[:3000])
    assert made.contains(k1[3000:], k2[3000:]).all()
    assert made.contains(k1[:3000], k2[:3000]).mean() < 0.01
    made.delete(k1[3000:], k2[3000:])
    assert not made.slots.any() and not len(made.stash)


LINE = "this line is long enough"
LINE_TEXTS = {
    0: None, 1: "", 2: "\n\n", 3: f"{LINE}\nown\n{LINE.upper()}", 4: f" \t{LINE}\r\nshort",
    5: f"x\n{LINE}\nZeile über alle Dokumente", 6: "Zeile über alle Dokumente", 7: "short\nshort",
    8: "zeile über alle dokumente\n" * 3, 9: "zeile ÜBER alle dokumente", 10: "short",
}
LINES = "doc_id long, text string, n_lines int, k1 string, shard int"


def plain_lines(texts, least=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = defaultdict(set)
    for doc, text in texts.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    out = {}
    for doc, text in texts.items():
        lines = (text or "").split("\n")
        stay = [
            x for x in lines
            if len(holders.get(key(x), ())) < least or max(holders[key(x)]) == doc
        ]
        out[doc] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def line_docs(spark, texts):
    return spark.createDataFrame([(k, t, 1, "x", 2) for k, t in texts.items()], LINES).repartition(3)


def lines_of(index, docs):
    rows = index.without_repeats(docs).collect()
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in rows}


def test_lines_come_and_go(spark, monkeypatch):
    monkeypatch.setattr(line_index, "LOAD", 2)  # several shards
    index = line_index.LineIndex(spark, shared_folder(spark, "lines"))
    docs = line_docs(spark, LINE_TEXTS)
    alone = {k: v[:1] + (0, t or "") for (k, v), t in
             zip(plain_lines(LINE_TEXTS).items(), LINE_TEXTS.values())}
    assert lines_of(index, docs) == alone
    assert index.commit("a", added=docs.where("doc_id < 5"))
    assert index.commit("b", added=docs.where("doc_id >= 3").unionByName(docs.where("doc_id = 6")))
    assert not index.commit("b", added=docs)
    assert lines_of(index, docs) == plain_lines(LINE_TEXTS)
    gone = {5: None, 8: None, 77: None}
    index.commit("gone", removed=line_docs(spark, gone))
    rest = {k: t for k, t in LINE_TEXTS.items() if k not in gone}
    assert lines_of(index, docs.where("doc_id NOT IN (5, 8)")) == plain_lines(rest)
    # The counts and filters are those of an index that never had the documents.
    fresh = line_index.LineIndex(spark, shared_folder(spark, "lines"))
    fresh.commit("all", added=line_docs(spark, rest))
    as_set = lambda df: set(map(tuple, df.collect()))
    assert as_set(index.counts()) == as_set(fresh.counts())
    marks = lambda i: sum(
        np.count_nonzero(np.frombuffer(r["slots"], np.uint16)) + len(r["stash"]) // 8
        for r in i._read("filters").collect()
    )
    assert marks(index) == marks(fresh) == index.counts().count()
    index.commit("back", added=docs.where("doc_id IN (5, 8)"))
    assert lines_of(index, docs) == plain_lines(LINE_TEXTS)
    index.commit("none", removed=docs.where("false"))
    index.commit("nothing", added=docs.where("false"))
    index.commit("all", removed=docs)
    assert index.counts().count() == 0 and lines_of(index, docs) == alone


def test_lines_of_odd_rows(spark):
    index = line_index.LineIndex(spark, shared_folder(spark, "lines"))
    docs = line_docs(spark, LINE_TEXTS).unionByName(
        spark.createDataFrame([(None, LINE, 1, "x", 2), (3, LINE, 1, "x", 2)], LINES)
    )
    with pytest.raises(ValueError):
        index.commit("a/b", added=docs)
    with pytest.raises(ValueError):
        index.commit("a")
    index.commit("first", removed=docs)
    index.commit("all", added=docs)
    rows = index.without_repeats(docs, keep=("n_lines", "k1")).toDF(
        "doc_id", "n", "k1", "text", "n_lines", "n_dropped"
    ).collect()
    want = plain_lines(LINE_TEXTS)
    assert len(rows) == len(LINE_TEXTS) + 2
    for r in rows:
        if r["doc_id"] is None:
            assert r["text"] == LINE
        elif r["n_lines"] == want[r["doc_id"]][0]:
            assert r["text"] == want[r["doc_id"]][2]
        else:
            assert (r["doc_id"], r["text"], r["n_dropped"]) == (3, "", 1)


def test_a_very_long_text_loses_its_lines(spark):
    body = F.expr("concat_ws('\n', transform(sequence(1, 150000),"
                  " i -> concat('a line of its own, number ', i * 10 + id)))")
    docs = spark.range(3).select(
        F.col("id").alias("doc_id"), F.concat(body, F.lit(f"\n{LINE}")).alias("text")
    )
    index = line_index.LineIndex(spark, shared_folder(spark, "lines"))
    index.commit("all", added=docs)
    rows = index.without_repeats(docs).select("doc_id", "n_lines", "n_dropped").collect()
    assert sorted(tuple(r) for r in rows) == [(0, 150001, 1), (1, 150001, 1), (2, 150001, 0)]


def test_lines_of_the_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in
            spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    want = plain_lines(docs)
    for r in queries.op11_cuckoo_lines(spark, sf_dir).collect():
        n, dropped, text = want.pop(r["doc_id"])
        assert (r["n_lines"], r["n_dropped"]) == (n, dropped)
        assert r["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert not want
