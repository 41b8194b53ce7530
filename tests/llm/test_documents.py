"""The operators over documents, against plain definitions and edge cases."""

import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speccurve.llm import (
    decontaminate, language, links, near_dup, paragraphs, pieces, quality, queries, sharding,
    token_counts, token_files,
)
from speccurve.llm.common import shared_folder

import brute

BASE = "".join(f"word{i} " for i in range(120)).strip()
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    None, "", "   \n\t", "one", "One two", "a b a b a b a b", BASE, BASE,
    BASE.replace("word7 ", "changed "), BASE.upper(), f"before it\n{PASSAGE}\nafter it",
    f"{PASSAGE}\nsomething else", f"{PASSAGE.replace('passage9 ', 'x ')}",
    "x" * 3000 + " " + "long " * 3000, "é É ß ﬁ   \x00 😀 ▁ a\r\nb", "#*$ &|<>% !!",
    "the and of to " * 30, "Der Hund und die Katze sind in dem Haus, und das ist nicht gut.",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts with keys, one row twice, and a row without a key; extra columns
    named like results."""
    rows = [(i, t, "en", "s", len(t or ""), 1, 2) for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, BASE, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df, {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def by_key(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- sharding ---------------------------------------------------------------------------------


def test_shards(spark, docs, nothing):
    rows = sharding.assign_shards(docs, [1.0, 2.0, 1.0], rows_per_bucket=2).collect()
    assert len(rows) == len(TEXTS) + 2
    for shard in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 3)
        if r["doc_id"] is not None:
            text = (TEXTS[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
    assert len({r["shard"] for r in rows if r["doc_id"] == 6}) == 1
    assert sharding.assign_shards(nothing, [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, [1.0, 0.0])


def test_few_records_move_and_weights_hold(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    four = by_key(sharding.assign_shards(keys, [1.0, 1.0, 1.0, 3.0]))
    five = by_key(sharding.assign_shards(keys, [1.0, 1.0, 1.0, 3.0, 1.0]))
    for key, row in four.items():
        assert five[key]["shard"] == row["grown_shard"]
    share = sum(r["shard"] == 3 for r in four.values()) / len(four)
    assert abs(share - 0.5) < 0.02


def test_written_shards(spark, docs):
    folder = shared_folder(spark, "written")
    assigned = sharding.assign_shards(docs, [1.0] * 4)
    sharding.write_shards(docs.drop("shard", "size"), assigned, folder)
    assert spark.read.parquet(folder).count() == docs.count()


# -- token files ------------------------------------------------------------------------------


def test_token_files_hold_the_librarys_ids(spark, docs, nothing, corpus):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    df, texts = corpus
    odd = {i + 10_000: t for i, t in enumerate(TEXTS)}
    odd[20_000] = "<|endoftext|> <|ENDOFTEXT|> it's 3.5,4 ΣΑΣ. İ,"
    more = spark.createDataFrame(list(odd.items()), "doc_id long, text string")
    texts = {**texts, **odd}
    files = token_files.write_token_files(df.select("doc_id", "text").union(more), path, 1)
    found = by_key(token_files.read_documents(files))
    start = 0
    for key in sorted(texts):
        ids = tokenizer.encode(texts[key] or "", add_special_tokens=False).ids + [1]
        row = found[key]
        assert (row["start"], row["n_tokens"]) == (start, len(ids)), key
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    again = token_files.write_token_files(docs, path, 1)
    assert token_files.read_documents(again).count() == len(TEXTS) + 2
    assert token_files.read_documents(token_files.write_token_files(nothing, path, 1)).count() == 0


def test_sequences_and_masks(tmp_path):
    from pyarrow.fs import LocalFileSystem

    fs = LocalFileSystem()
    writer = token_files.SequenceWriter(fs, f"{tmp_path}/x", pa.uint16(), pa.int64())
    unit = token_files.SEQUENCE * token_files.BATCH_SEQUENCES
    parts = [np.arange(n, dtype=np.uint16) for n in (0, 5, unit, 3, 2 * unit)]
    for i, part in enumerate(parts):
        writer.add(pa.array([i]), [part])
    writer.close()
    reader = token_files.SequenceReader(fs, f"{tmp_path}/x")
    for batch in reader.documents():
        row = batch.to_pylist()[0]
        assert (reader.ids(row["first"], row["n_tokens"]) == parts[row["doc_id"]]).all()
    masks = sum(
        int(np.sum(reader.tokens.get_batch(k).column(1).flatten().to_pylist()))
        for k in range(reader.tokens.num_record_batches)
    )
    assert masks == sum(map(len, parts))


# -- pieces -----------------------------------------------------------------------------------


def test_pieces_are_the_librarys(spark, docs, nothing, corpus):
    from sentencepiece import SentencePieceProcessor

    path = queries.vocabulary("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    df, texts = corpus
    for table, known in ((df, texts), (docs, dict(enumerate(TEXTS)))):
        for row in pieces.encode_pieces(table, path, keep=("lang",)).collect():
            if row["doc_id"] is None:
                continue
            ids = library.encode(known[row["doc_id"]] or "")
            assert row["ids"] == ids
            assert row["decoded"] == library.decode(ids)
    assert pieces.encode_pieces(docs, path).count() == len(TEXTS) + 2
    assert pieces.encode_pieces(nothing, path).count() == 0


def test_prefix_table_on_random_strings():
    import random

    from speccurve.llm.pieces import PieceEncoder

    with open(queries.vocabulary("piece_bpe_32k.model"), "rb") as file:
        encoder = PieceEncoder(file.read())
    draw = random.Random(5)
    signs = "ab eth.,\n▁inér的😀'\"(x)$1 2\t" + "".join(encoder.texts[:200])
    for _ in range(2000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 40)))
        ids = np.frombuffer(encoder.encode(text), "<i4").tolist()
        assert ids == encoder.library.encode(text), text


# -- quality ----------------------------------------------------------------------------------


def test_features_and_edges(spark, docs, nothing):
    rows = quality.quality(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = BASE if r["doc_id"] is None else TEXTS[r["doc_id"]]
        w = brute.words(text)
        assert r["n_words"] == len(w)
        assert r["word_chars"] == sum(map(len, w))
        assert r["n_repeat_words"] == brute.repeated_words(text)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
    assert quality.quality(nothing).count() == 0


def test_votes_keep_good_documents(spark, corpus, sf_dir):
    df, texts = corpus
    rows = by_key(queries.op7_weak_supervision(spark, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    judged = [(r["quality"], rows[r["doc_id"]]) for r in labels]
    good = [x["kept"] for q, x in judged if q == 1 and not x["base_failed"]]
    bad = [x["kept"] for q, x in judged if q == 0 and not x["base_failed"]]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_accuracies_are_recovered():
    draw = np.random.default_rng(3)
    truth = draw.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.85])
    cast = draw.random((20_000, 4)) < 0.8
    says = np.where(draw.random((20_000, 4)) < right, truth[:, None], ~truth[:, None])
    votes = np.where(cast, np.where(says, 1, 2), 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, good, bad = quality.fit(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.02
    assert np.abs(good - right).max() < 0.03
    assert np.abs(bad - right).max() < 0.05


# -- near duplicates --------------------------------------------------------------------------


@pytest.mark.parametrize("size", [2, 5])
def test_components_of_near_duplicates(corpus, size):
    df, texts = corpus
    sets = {k: brute.shingles(t, size) for k, t in texts.items()}
    want = brute.components(sets)
    for key, row in by_key(near_dup.near_duplicates(df, shingle=size)).items():
        assert (row["n_shingles"], row["component"]) == (len(sets[key]), want[key]), key


def test_near_duplicate_edges(docs, nothing):
    rows = near_dup.near_duplicates(docs, shingle=2).collect()
    assert len(rows) == len(TEXTS) + 2
    component = {r["doc_id"]: r["component"] for r in rows}
    assert component[None] is None
    want = brute.components({i: brute.shingles(t, 2) for i, t in enumerate(TEXTS)})
    assert {k: v for k, v in component.items() if k is not None} == want
    assert component[0] == 0 and component[1] == 1 and component[7] == component[8] == 6
    assert near_dup.near_duplicates(nothing).count() == 0


def test_large_nodes_branch_and_are_cut(spark, monkeypatch):
    """Many near copies with small nodes: branching and blocks lose no link."""
    monkeypatch.setattr(near_dup, "NODE", 4)
    draw = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        w = list(base)
        for at in draw.choice(60, draw.integers(1, 6), replace=False):
            w[at] = f"x{i}_{at}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute.components({i: brute.shingles(t, 2) for i, t in texts})
    found = by_key(near_dup.near_duplicates(df, shingle=2))
    assert {k: r["component"] for k, r in found.items()} == want
    assert len(set(want.values())) > 1


def exact_pairs(spark, n):
    """Sets (key, h) of ``n`` pairs that have just 80 % in common, and nothing else."""
    rows = []
    for i in range(n):
        own = near_dup.mix(np.arange(10 * i + 1, 10 * i + 11, dtype=np.uint64))
        own = own.view(np.int64).tolist()
        rows += [(2 * i, own[:9]), (2 * i + 1, own[:8] + own[9:])]
    return spark.createDataFrame(rows, "key long, h array<bigint>")


def components_in_one_node(spark, sets, places, **options):
    classes = near_dup.set_classes(near_dup.signed_sets(sets, places))
    path, pivot = (F.lit(x).cast("long").alias(c) for x, c in ((7, "path"), (0, "pivot")))
    members = classes.select(path, "rep", pivot)

    def sets_of(reps):
        return sets.join(reps.withColumnRenamed("rep", "key"), "key", "left_semi")

    return near_dup.linked(members, classes, sets_of, 80, places, **options)


def test_no_pair_of_a_large_bucket_is_lost(spark, monkeypatch):
    sets, seen = exact_pairs(spark, 150), []
    inner = near_dup.linked
    monkeypatch.setattr(paragraphs, "linked", lambda *a, **b: seen.append((a, b)) or inner(*a, **b))
    lines = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE)], "doc_id long, text string")
    assert paragraphs.repeated_paragraphs(lines).count() == 1
    # As paragraphs are compared, but all in one bucket.
    options = seen[0][1] | {"levels": seen[0][0][5]} if len(seen[0][0]) > 5 else seen[0][1]
    found = by_key(components_in_one_node(spark, sets, seen[0][0][4], **options), "node")
    assert {k: r["component"] for k, r in found.items()} == {k: k - k % 2 for k in range(300)}


def test_no_pair_of_a_large_node_is_lost(spark):
    found = by_key(components_in_one_node(spark, exact_pairs(spark, 150), near_dup.PLACES), "node")
    assert {k: r["component"] for k, r in found.items()} == {k: k - k % 2 for k in range(300)}


def test_chains_are_one_component(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    found = links.components(spark.createDataFrame(rows, "a long, b long"))
    labels = {r["node"]: r["component"] for r in found.collect()}
    assert labels == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    known = links.components(spark.createDataFrame(rows, "a long, b long"))
    more = spark.createDataFrame([(40, 101), (300, 200)], "a long, b long")
    labels = {r["node"]: r["component"] for r in links.extended(known, more).collect()}
    assert labels == {**dict.fromkeys([*range(41), 100, 101], 0), 300: 200, 200: 200}
    assert links.extended(known, more.limit(0)) is known


# -- passages ---------------------------------------------------------------------------------


def cut_by_brute_force(texts):
    return windows_cut_by_brute_force(lines_cut_by_brute_force(texts))


def windows_cut_by_brute_force(texts):
    """Windows at the same anchors, compared by all pairs."""
    size, places, grams = paragraphs.WINDOW, {}, {}
    for key, text in texts.items():
        w = brute.words((text or "").translate(brute.LOWER))
        tokens = [zlib.crc32(x.encode()) for x in w]
        marks = [gram_hash(tokens[i : i + 5]) for i in range(len(w) - size + 1)]
        step = min(paragraphs.STEP, len(marks))
        runs = [marks[i : i + step] for i in range(len(marks) - step + 1)] if marks else []
        places[key] = sorted({i + run.index(min(run)) for i, run in enumerate(runs)})
        for i in places[key]:
            grams.setdefault(marks[i], []).append((key, i, tuple(w[i : i + size])))
    classes, out = {}, {}
    for found in grams.values():
        for key, i, w in found:
            classes.setdefault(w, []).append((key, i))
    sets = {
        min(classes[w]): brute.shingles(" ".join(w), 5)
        for found in grams.values() if len({w for *_, w in found}) > 1 for *_, w in found
    }
    of_class = brute.components(sets)
    first = {at: of_class.get(min(ats), min(ats)) for ats in classes.values() for at in ats}
    for key, text in texts.items():
        dead = {j for (k, i), (other, _) in first.items() if k == key and other < key
                for j in range(i, i + size)}
        if not dead:
            out[key] = text
            continue
        # Words with the white space behind them; a cut over a line end leaves one.
        parts = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
        left = text[: len(text) - len("".join(parts))]
        for j, part in enumerate(parts):
            if j not in dead:
                left += part
            elif "\n" in part and left and not left.endswith("\n"):
                left += "\n"
        out[key] = left
    return out


def gram_hash(tokens):
    def scramble(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    h = 0
    for token in tokens:
        h = scramble(h ^ token)
    return h


def lines_cut_by_brute_force(texts):
    sets = {}
    for key, text in texts.items():
        for at, line in enumerate((text or "").split("\n")):
            if len(brute.words(line)) >= paragraphs.LEAST_WORDS:
                sets[key, at] = brute.shingles(line, 5)
    first = brute.components(sets)
    gone = {k for k in sets if first[k] != k}
    return {
        key: None if text is None else "\n".join(
            line for at, line in enumerate(text.split("\n")) if (key, at) not in gone
        )
        for key, text in texts.items()
    }


def test_passages_are_cut(corpus, docs, nothing):
    df, texts = corpus
    few = {k: t for k, t in texts.items() if k < 120}
    found = by_key(paragraphs.cut_repeats(df.where("doc_id < 120")))
    assert {k: r["text"] for k, r in found.items()} == cut_by_brute_force(few)
    rows = paragraphs.cut_repeats(docs, keep=("size",)).collect()
    assert len(rows) == len(TEXTS) + 2
    want = cut_by_brute_force(dict(enumerate(TEXTS)))
    assert all(r["text"] == want[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert want[11] == "something else" and want[12] == "" and want[10] == TEXTS[10]
    shared = {r["doc_id"]: r["n_shared"] for r in rows}
    assert [k for k in range(len(TEXTS)) if shared[k]] == [6, 7, 8, 9, 10, 11, 12]
    inside = docs.where("doc_id = 1").withColumn("text", F.lit(f"{PASSAGE}\n{PASSAGE}"))
    row = paragraphs.cut_repeats(inside).first()
    assert (row["text"], row["n_shared"], row["removed"]) == (PASSAGE, 0, [1])
    assert paragraphs.cut_repeats(nothing).count() == 0


def shared_runs(texts, size):
    """Runs of ``size`` words that several texts have."""
    seen = {}
    for key, text in texts.items():
        w = brute.words((text or "").translate(brute.LOWER))
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), set()).add(key)
    return sum(len(keys) > 1 for keys in seen.values())


def test_no_run_of_fifty_words_stays_twice(corpus):
    """After exact near duplicates are out, over all documents."""
    df, texts = corpus
    first = brute.components({k: brute.shingles(t, 5) for k, t in texts.items()})
    left = {k: t for k, t in texts.items() if first[k] == k}
    kept = df.where(F.col("doc_id").isin(list(left)))
    found = {k: r["text"] for k, r in by_key(paragraphs.cut_repeats(kept)).items()}
    assert found == cut_by_brute_force(left)
    before, after = shared_runs(left, 50), shared_runs(found, 50)
    assert before > 500 and after <= 0.05 * before


def test_passages_within_and_across_lines(spark):
    draw = np.random.default_rng(5)
    def noise(n):
        return " ".join(f"n{x}" for x in draw.integers(0, 10**9, n))

    wrapped = "\n".join(" ".join(PASSAGE.split()[i : i + 7]) for i in range(0, 60, 7))
    alone = noise(400_000)
    rows = [
        (1, f"{noise(40)} {PASSAGE} {noise(40)}"), (2, f"{noise(90)} {PASSAGE.upper()}"),
        (3, f"{noise(9)}\n{wrapped}\n{noise(9)}"), (4, alone), (5, noise(100)),
        (6, f"{alone} {noise(3)}\n{PASSAGE} {noise(70)}"), (7, None), (8, ""), (8, "two"),
        (None, PASSAGE),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x"))
    found = {(r["doc_id"], r["n_paragraphs"]): r for r in paragraphs.cut_repeats(df).collect()}
    text = {k: r["text"] for k, r in found.items()}
    assert text[1, 1] == rows[0][1] and text[4, 1] == alone and text[5, 1] == rows[4][1]
    assert found[1, 1]["n_shared"] and found[4, 1]["n_shared"] and not found[5, 1]["n_shared"]
    for key, n in ((2, 1), (3, 11), (6, 2)):
        assert found[key, n]["spans"] or found[key, n]["removed"]
        left = [w for w in brute.words(text[key, n].lower()) if w.startswith("passage")]
        assert len(left) <= 2 * (paragraphs.STEP - 1)
    assert brute.words(text[3, 11])[:9] == rows[2][1].split()[:9]
    assert brute.words(text[3, 11])[-9:] == rows[2][1].split()[-9:]
    assert text[7, 0] is None and text[8, 1] in ("", "two") and text[None, 1] == PASSAGE


def test_bands_reach_the_recall():
    for similarity in (0.5, 0.8, 0.95):
        bands, rows = paragraphs.tune(similarity, 0.999)
        assert 1 - (1 - similarity**rows) ** bands >= 0.999


# -- decontamination --------------------------------------------------------------------------


@pytest.mark.parametrize("small", [True, False])
def test_windows_of_items(spark, docs, nothing, small, monkeypatch):
    if not small:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    items = {
        1: "word3 WORD4, word5", 2: "nowhere to be found", 3: None, 4: "...", 5: "One",
        6: PASSAGE, 7: " ".join(f"word{i}" for i in range(20, 31)), 10: "long long",
    }
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = decontaminate.decontaminate(docs, table, keep=("size",)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = BASE if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert r["n_words"] == len(brute.benchmark_words(text))
        assert (r["n_hit"], r["items"]) == brute.hits(text, items), r["doc_id"]
    assert decontaminate.decontaminate(nothing, table).count() == 0
    none = decontaminate.decontaminate(docs, table.where("item_id = 4")).collect()
    assert len(none) == len(TEXTS) + 2 and all(r["n_hit"] == 0 for r in none)


def test_decontamination_of_the_corpus(spark, sf_dir, corpus):
    df, texts = corpus
    items = {r["item_id"]: r["text"]
             for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    found = queries.op2_prefix_decontamination(spark, sf_dir).collect()
    want = {k: brute.hits(t, items) for k, t in texts.items()}
    assert {r["doc_id"]: r["n_hit"] for r in found} == {k: v[0] for k, v in want.items()}
    plan = decontaminate.decontaminate(
        df, spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


# -- token totals -----------------------------------------------------------------------------


def test_totals_follow_signed_batches(spark, docs, nothing):
    totals = token_counts.TokenTotals(spark, shared_folder(spark, "totals"))
    assert totals.totals().count() == 0
    ranks = queries.vocabulary("byte_bpe_50k.tiktoken")
    counts = token_counts.count_tokens(docs, "v1", ranks, queries.byte_pair_pattern()).cache()
    assert totals.commit("a", token_counts.signed(counts, 1))
    assert not totals.commit("a", token_counts.signed(counts, 1))
    once = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in totals.totals().collect()}
    assert sum(v[0] for v in once.values()) == len(TEXTS) + 2 and (None, None) in once
    totals.compact()
    totals.commit("b", token_counts.signed(counts.where("doc_id IS NULL"), -1))
    assert not totals.commit("a", token_counts.signed(counts, 1))
    totals.compact()
    left = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in totals.totals().collect()}
    assert left == {k: v for k, v in once.items() if k != (None, None)}
    assert totals.committed() == {"a", "b"}
    assert totals.commit("empty", token_counts.signed(counts.limit(0), 1))
    assert token_counts.count_tokens(nothing, "v1", ranks, queries.byte_pair_pattern()).count() == 0
    with pytest.raises(ValueError):
        totals.commit("../x", token_counts.signed(counts, 1))


# -- language ---------------------------------------------------------------------------------


def test_language_on_held_out_texts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train, rest = df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")
    found = language.identify(rest, labelled=train, keep=("lang",)).collect()
    right = sum(r["language"] == r["lang"] for r in found)
    assert right >= 0.97 * len(found)
    assert sum(r["accepted"] for r in found) >= 0.97 * len(found)


def test_other_evidence_decides_where_text_is_silent(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], f".{r['lang']}", f"host-{r['lang']}")
            for r in df.select("doc_id", "text", "lang").collect()]
    rows += [(-1, "12 34", "fr", ".fr", "host-fr"), (-2, None, "de", None, None),
             (-3, "", None, None, "host-es"), (-4, None, None, None, None)]
    table = spark.createDataFrame(
        rows, "doc_id long, text string, declared string, suffix string, host string"
    )
    found = by_key(language.identify(
        table, declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"), labelled=df,
    ))
    assert [found[k]["language"] for k in (-1, -2, -3)] == ["fr", "de", "es"]
    assert found[-4]["language"] == "en"  # the most frequent
    assert not any(found[k]["accepted"] for k in (-1, -2, -3, -4))


def test_language_edges(spark, docs, nothing):
    rows = language.identify(docs, declared=F.col("lang"), host=F.col("source")).collect()
    assert len(rows) == len(TEXTS) + 2
    assert language.identify(nothing).count() == 0
    unlabelled = language.identify(docs, labelled=docs.where("lang = 'none'")).collect()
    assert all(r["language"] is None and not r["accepted"] for r in unlabelled)


def test_language_terms_are_not_copied(spark, docs):
    """A filter on the result holds no copies of the terms of the posterior."""
    rows = language.identify(docs, declared=F.col("lang"), host=F.col("source"))
    plan = rows.where("NOT accepted")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("exp(") <= 8
    assert len(plan) < 20_000


def test_stored_tables_leave_no_shuffle_files(spark):
    from speccurve.llm import common

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {n for n in names if n.startswith("shuffle_")}

    known, before = files(), spark.conf.get(common._CLEANED)
    table = common.stored(spark.range(5000).groupBy("id").count(), "x")
    for _ in range(50):  # they are deleted behind the query
        if not files() - known:
            break
        time.sleep(0.1)
    assert not files() - known
    assert table.count() == 5000 and spark.conf.get(common._CLEANED) == before


def test_texts_are_anchored_together_as_alone():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, n)).encode()
             for n in (0, 1, 29, 30, 31, 48, 49, 50, 400, 0, 70)]
    who, *found = paragraphs.anchors_of(texts)
    for i, text in enumerate(texts):
        for one, every in zip(paragraphs.anchors(text), found, strict=True):
            assert one.tolist() == every[who == i].tolist()
