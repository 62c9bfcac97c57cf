"""Operators on documents against brute force, and their defined results on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from factorspark.llm import classify, components, mixing, secret_scan, simhash_dedup
from factorspark.llm.subword import Features, counts, plain_table, scores

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, number int, row_number_ string, size int"
KEY = "sk9Qx7Lm2Vt5Rb8Wz4Ny"
ODD = [
    (1, None, "en", "a", 1, "x", 0),
    (2, "", "en", None, 1, "x", 0),
    (None, "token: abcdef1", "de", "a", 1, "x", 0),
    (3, "password: token: abcdef", None, "b", 1, "x", 0),
    (3, "password: token: abcdef", None, "b", 1, "x", 0),
    (4, f"\U0001F511\U0001F511 API-KEY api_key = '{KEY}', {KEY}\n" + "x " * 3000 + f"AKIA{'Z9' * 8}", "fr", "c", 1, "x", 0),
    (5, f"bare {KEY} here", "en", "c", 1, "x", 0),
    (6, "0123456789abcdef01234567 ToKeN=0123456789abcdef01234567", "en", "d", 1, "x", 0),
    (7, " \t\n\x0b\x0c\r", "en", "d", 1, "x", 0),
    (8, "one two three four", "en", "e", 1, "x", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def base_spans(text):
    text, found = text or "", []
    assign = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for order, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [x[2] for x in sorted(found)]


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_base_secrets_equal_a_plain_scan(table, request):
    docs = request.getfixturevalue(table)
    wanted = Counter()
    for row in docs.collect():
        spans = base_spans(row["text"])
        kinds = Counter(s.split(":")[0] for s in spans)
        wanted[row["doc_id"], kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    got = secret_scan.secret_report(docs).collect()
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == wanted


def test_ownership_decides_on_bare_values(spark, odd):
    report = {r["doc_id"]: r for r in secret_scan.secret_report(odd).collect()}
    assert report[5]["spans"] == "owned:5:25"  # a live value of one owner, without a key word before it
    assert report[4]["n_live"] == 2 and report[4]["spans"].count("owned") == 1
    copied = spark.createDataFrame([(i, f"see {KEY}", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    assert {r["spans"] for r in secret_scan.secret_report(copied).collect()} == {""}
    assigned = spark.createDataFrame([(i, f"token={KEY}", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    assert {(r["n_assign"], r["n_live"], r["n_copied"]) for r in secret_scan.secret_report(assigned).collect()} == {(1, 0, 1)}


def test_documents_of_one_hot_source_decide_too(spark):
    """A value in many documents of one owner is copied; one in few is live."""
    rows = [(i, f"see {KEY} and token={KEY}x", "hot") for i in range(60)] + [(100 + i, f"token={KEY}y", "hot") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["doc_id"] < 100, r["spans"].count("owned"), r["n_live"], r["n_copied"], r["most_owners"], r["most_documents"])
           for r in secret_scan.secret_report(docs).collect()}
    assert got == {(True, 0, 0, 1, 1, 60), (False, 0, 1, 0, 1, 50)}
    assert {r["n_live"] for r in secret_scan.secret_report(docs, max_documents=60).where("doc_id < 100").collect()} == {2}


def test_masking_replaces_spans_alone(odd, empty):
    masked = secret_scan.mask_secrets(odd)
    assert masked.columns == odd.columns and masked.count() == len(ODD)
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    mask = secret_scan.MASK
    assert texts[1] is None and texts[2] == "" and texts[3] == "password: token: abcdef"
    assert texts[None] == mask and texts[5] == f"bare {mask} here" and texts[6] == f"{mask} {mask}"
    assert texts[4] == f"\U0001F511\U0001F511 API-KEY {mask}', {mask}\n" + "x " * 3000 + mask
    assert secret_scan.mask_secrets(empty).count() == 0 and secret_scan.secret_report(empty).count() == 0


def shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by naive rounds of sharing."""
    total, names = sum(sizes.values()), list(sizes)
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(total)
    while open_:
        share = sum(weight[n] for n in open_)
        full = {n for n in open_ if left * weight[n] / share > most * sizes[n]}
        if not full:
            for n in open_:
                target[n] = left * weight[n] / share
            break
        for n in full:
            target[n] = float(most * sizes[n])
            left -= target[n]
        open_ -= full
    return target


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_mixing_meets_targets(table, request):
    docs = request.getfixturevalue(table)
    plan = mixing.mix_plan(docs).toPandas().astype(object).where(lambda x: x.notna(), None)
    texts = docs.toPandas()
    assert len(plan) == len(texts)
    counted = defaultdict(int)
    for text, source in zip(texts["text"], texts["source"]):
        counted[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    ordered = dict(sorted(counted.items(), key=lambda x: (x[0] is None, (x[0] or "").encode())))
    wanted = shared(ordered)
    for row in plan.to_dict("records"):
        assert row["source_size"] == counted[row["source"]]
        assert row["target"] == pytest.approx(wanted[row["source"]])
        assert row["taken"] <= 3 * row["size"] and (row["size"] == 0 or row["taken"] % row["size"] == 0)
        rate = row["target"] / row["source_size"] if row["source_size"] else 0
        if row["size"]:
            assert int(rate) <= row["taken"] // row["size"] <= int(rate) + 1
    again = mixing.mix_plan(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken")).toPandas()
    first = plan.groupby("doc_id", dropna=False)["taken"].sum()
    assert {(k, v) for k, v in again.astype(object).where(again.notna(), None).itertuples(index=False)} == {
        (None if k != k else k, v) for k, v in first.items()}


def test_mixed_rows_are_the_plan(spark, odd, empty):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 1300, "x").otherwise("y").alias("source"))
    plan = mixing.mix_plan(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    for row in plan:
        assert row["taken"] == pytest.approx(row["target"], rel=0.06)
    rows = mixing.mix(many).groupBy("source").agg((F.count("*") * 4).alias("taken")).collect()
    assert {(r["source"], r["taken"]) for r in rows} == {(r["source"], r["taken"]) for r in plan}
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.mix_plan(empty).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def linked(prints, ids, reach=3):
    """Smallest id reachable, by all pairs."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= reach
    label = np.array(ids, float)
    while True:
        further = np.where(near, label[None, :], np.inf).min(axis=1)
        if (further == label).all():
            return label.astype(int)
        label = further


@pytest.mark.parametrize("leaf_rows", [4096, 8])
def test_simhash_equals_all_pairs(documents, leaf_rows):
    rows = documents.collect()
    prints = np.array([plain_fingerprint(r["text"]) for r in rows], np.uint64)
    wanted = linked(prints, [r["doc_id"] for r in rows])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.near_duplicates(documents, leaf_rows=leaf_rows).collect()}
    assert got == {r["doc_id"]: (f"{p:016x}", c) for r, p, c in zip(rows, prints.tolist(), wanted)}
    kept = {r["doc_id"] for r in simhash_dedup.one_of_each(documents, leaf_rows=leaf_rows).collect()}
    assert kept == set(wanted.tolist())


@pytest.mark.parametrize("seed, root_leaves", [(1, 1024), (2, 1024), (3, 2), (4, 5)])
def test_trees_lose_no_link(spark, seed, root_leaves):
    """Random prints, dense clusters, chains, and many that share a half; few leaves make shards that are routed on."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, 40, np.uint64)
    prints = [rng.integers(0, 2**64, 500, np.uint64), centres]
    for _ in range(3):
        flips = np.left_shift(np.uint64(1), rng.integers(0, 64, 800).astype(np.uint64))
        prints.append(rng.choice(np.concatenate(prints), 800) ^ flips)
    prints.append((centres[0] & simhash_dedup.HALVES[0]) | rng.integers(0, 2**32, 600).astype(np.uint64))
    prints = np.unique(np.concatenate([*prints, [np.uint64(0)]]))
    wanted = linked(prints, np.arange(len(prints)))
    table = spark.createDataFrame(pd.DataFrame({"print": prints.view(np.int64)}))
    roots = components.components(simhash_dedup.links(table, leaf_rows=64, root_leaves=root_leaves)).toPandas()
    place = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    label = np.arange(len(prints))
    groups = defaultdict(list)
    for node, root in roots.itertuples(index=False):
        groups[root].append(place[node])
    for members in groups.values():
        label[members] = min(members)
    assert (label == wanted).all()


def test_near_copies_of_odd_rows(odd, empty):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup.near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    assert {c for i, p, c in got if p == "0" * 16} == {1}  # no words: linked to each other
    assert [c for i, _, c in got if i == 3] == [3, 3] and [c for i, _, c in got if i is None] == [None]
    kept = simhash_dedup.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8]
    assert simhash_dedup.near_duplicates(empty).count() == 0 and simhash_dedup.one_of_each(empty).count() == 0


def test_stars_find_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7), (600, 601), (600, 602), (None, 3)]
    roots = dict(components.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert roots == {i: 0 for i in range(201)} | {400: 400, 500: 400, 600: 600, 601: 600, 602: 600}


def test_language_is_found_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = classify.identify(docs, classify.language_model(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    test = got[got["held_out"] & got["text"].str.contains(r"[^\W\d_]", na=False)]
    assert (test["lang_pred"] == test["lang"]).mean() > 0.98
    assert got["score"].between(0, 1).all() and test["accepted"].mean() > 0.99


def test_language_of_odd_rows(odd, empty, documents):
    model = classify.language_model(documents)
    got = classify.identify(odd, model).collect()
    assert len(got) == len(ODD)
    unknown = {r["doc_id"] for r in got if r["lang_pred"] == classify.UNKNOWN}
    assert unknown == {1, 2, 7} and all(r["score"] == 0 for r in got if r["doc_id"] in unknown)
    kept = classify.keep_identified(odd, model)
    assert kept.columns == odd.columns and {1, 2, 7}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert classify.language_model(empty) is None
    assert classify.identify(empty, None).count() == 0 and classify.identify(odd, None).where("lang_pred <> 'und'").count() == 0


def test_quality_on_held_out_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = classify.quality_model(docs, labels)
    got = classify.quality_scores(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert np.mean(good[:, None] > bad[None, :]) > 0.97
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    scored = classify.quality_scores(odd, model)
    assert scored.count() == len(ODD) and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert classify.quality_model(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None


def test_features_do_not_depend_on_the_batch():
    features = Features(orders=(1, 3), words=True, buckets=1 << 10, table=plain_table())
    table = np.random.default_rng(0).normal(size=(1 << 10, 2)).astype(np.float32)
    texts = [b"", b"a", "café au lait lait".encode(), b"word " * 100_000, b"  x\ty  "]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together, number = scores(features, table, data, offsets)
    for i, text in enumerate(texts):
        alone, _ = scores(features, table, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert together[i] == pytest.approx(alone[0], abs=1e-6)
        ids, times = counts(features, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert times.sum() == number[i]
        if len(ids):
            assert together[i] == pytest.approx((table[ids] * times[:, None]).sum(axis=0) / times.sum(), abs=1e-4)
