"""Merge encoding, Merkle manifests and centroid clusters against brute force and odd inputs."""

import hashlib
import random
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from routeloom.llm import centroids, manifest, merge_encode

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, ids string, row string, root string"
ODD = [
    (1, None, "en", "x", "r", None), (2, "", None, "x", None, "q"), (3, "word " * 30_000, "en", None, "r", "q"), (4, "same text", "en", "x", "r", "q"),
    (4, "same text", "en", "x", "r", "q"), (5, "same text", "de", "x", "r", "q"), (None, "no id", "en", "x", "r", "q"), (6, "x" * 200_000, "", "x", "r", "q"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def pieces():
    return merge_encode.Pieces.from_sentencepiece(PIECES)


def _ids(pieces, text):
    return array("i", pieces.encode([text])[0]).tolist()


def test_encoding_equals_the_library_on_hostile_texts(pieces, library):
    rng = random.Random(11)
    parts = ["a", "e", "th", "in", "the", "▁", " ", "  ", "\n", "é", "中", "語", "😀", "\x00", "12", "aaa", "==", "--", "<s>", "<0x0A>", "\t", "ß", "́", "_{", "²", ").", "...", "ing,"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        assert _ids(pieces, text) == library.encode(text), text
    for _ in range(2000):
        text = " ".join("".join(rng.choice("abcdes") for _ in range(rng.randrange(1, 40))) for _ in range(3))
        assert _ids(pieces, text) == library.encode(text), text
    for text in ["a" * 50_000, "ab" * 20_000, " " * 20_000, "\n" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(50_000))]:
        assert _ids(pieces, text) == library.encode(text)


def test_decoding_equals_the_library_on_any_ids(pieces, library):
    rng = random.Random(12)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 259, 28705]) for _ in range(rng.randrange(9))]
        assert pieces.decode(ids) == library.decode(ids), ids


def test_small_vocabularies_equal_the_merges_themselves():
    rng = random.Random(13)
    for _ in range(60):
        words = {"▁", "a", "b", "c"} | {"".join(rng.choice("ab▁c") for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(2, 14))}
        # scores that repeat: the leftmost of equal merges goes first
        p = merge_encode.Pieces({w: (i, float(rng.randrange(5))) for i, w in enumerate(sorted(words))}, None, 99)
        for _ in range(40):
            text = "".join(rng.choice("abc d") for _ in range(rng.randrange(1, 25)))
            want, unknown = [], False
            for run in p._merge("▁" + text.replace(" ", "▁")):
                known = run in p.texts
                if known or not unknown:
                    want.append(p.texts[run][0] if known else 99)
                unknown = not known
            assert _ids(p, text) == want, (words, text)


def test_encode_and_decode_tables(spark, odd, none, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.ids, r.decoded) for r in merge_encode.decode(merge_encode.encode(docs, PIECES), PIECES).select("doc_id", "ids", "decoded").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got == {i: (library.encode(t), library.decode(library.encode(t))) for i, t in texts.items()}
    encoded = merge_encode.encode(odd, PIECES)
    assert encoded.columns == odd.columns
    rows = merge_encode.decode(encoded, PIECES, text_col="row").collect()
    assert [(r.doc_id, r.ids, r.row) for r in rows] == [(o[0], library.encode(o[1] or ""), o[1] or "") for o in ODD]
    assert merge_encode.decode(merge_encode.encode(none, PIECES), PIECES).count() == 0
    assert merge_encode.decode(odd.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), PIECES).where("decoded is not null").count() == 0


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _tree(leaves, arity):
    """(root, proofs) of a tree in memory; a proof is a list of (before, after)."""
    at, level, proofs = list(range(len(leaves))), list(leaves), [[] for _ in leaves]
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place // arity * arity
            proofs[i].append(("".join(level[first:place]), "".join(level[place + 1 : first + arity])))
            at[i] = place // arity
        level = [_sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0], proofs


@pytest.mark.parametrize(("arity", "block_levels"), [(2, 2), (3, 1), (2, 12)])
def test_manifest_against_trees_in_memory(spark, arity, block_levels):
    rng = random.Random(14)
    langs = [None] * 1 + ["", "é"] + ["en"] * 77 + ["de"] * 16 + ["z"] * 2 + ["a"] * 5
    rows = [(i, lang, _sha(str(i)), i % 3) for i, lang in enumerate(langs)] + [(3, "en", _sha("3"), 0), (None, "en", _sha("n"), 1), (3, "en", _sha("other"), 0)]
    rng.shuffle(rows)
    got = manifest.manifest(spark.createDataFrame(rows, "doc_id long, lang string, leaf string, root long").repartition(3), tree="lang", order="doc_id", leaf="leaf", arity=arity, block_levels=block_levels)
    folded = got.select("*", manifest.folded(F.col("leaf"), F.col("proof")).alias("again"), manifest.siblings(F.col("proof")).alias("flat")).collect()
    trees = {}
    for i, lang, leaf, _ in rows:
        trees.setdefault(lang, []).append((-1 if i is None else i, leaf))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    made = {k: _tree([x[1] for x in sorted(trees[k])], arity) for k in order}
    root, above = _tree([made[k][0] for k in order], arity)
    want = []
    for place, k in enumerate(order):
        for (i, leaf), path in zip(sorted(trees[k]), made[k][1], strict=True):
            want.append((None if i < 0 else i, k, leaf, made[k][0], root, [tuple(s) for s in path + above[place]]))
    rank = lambda r: (str(r[1]), -1 if r[0] is None else r[0], r[2])
    assert sorted([(r.doc_id, r.lang, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in folded], key=rank) == sorted(want, key=rank)
    assert all(r.again == r.root and r.flat == "".join(a + b for a, b in r.proof) for r in folded)


def test_manifest_on_odd_inputs(spark, odd, none):
    leaves = odd.withColumn("leaf", manifest.leaf_digest(*(F.col(c) for c in ("doc_id", "lang", "text"))))
    got = manifest.manifest(leaves, tree="lang", order="doc_id", leaf="leaf").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(o[0]) for o in ODD)
    assert {r.leaf for r in got if r.doc_id == 1} == {_sha("1:12:en-")} and len({r.root for r in got}) == 1
    assert {r.leaf for r in got if r.doc_id == 2} == {_sha("1:2-0:")}
    assert manifest.manifest(none.withColumn("leaf", F.lit("")), tree="lang", order="doc_id", leaf="leaf").count() == 0
    alone = manifest.manifest(leaves.where("doc_id = 1"), tree="lang", order="doc_id", leaf="leaf").first()
    assert alone.root == alone.subroot == alone.leaf and alone.proof == []
    # one changed digest gives another root
    changed = manifest.manifest(leaves.withColumn("leaf", F.when(F.col("doc_id") == 5, F.lit("0")).otherwise(F.col("leaf"))), tree="lang", order="doc_id", leaf="leaf").first()
    assert changed.root != got[0].root


def _clusters(vectors, k, rounds, scale=256):
    """Whole distances every round, in Python integers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in vectors]
    ranked = sorted(kept, key=lambda r: (r[0] is None, _sha(f"2:{r[0]}"), r[1]))
    cents = [v for _, v in ranked[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    return sorted(out, key=repr), cents


def hashed():
    return F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)


def test_centroids_against_whole_distances(spark):
    rng = np.random.default_rng(15)
    for n, k, spread in [(150, 7, 0.6), (40, 40, 0.01), (5, 9, 1.0), (60, 4, 3000.0)]:
        base = rng.standard_normal((3, 6))
        rows = [(i // 2 if i % 7 == 0 else i, (base[i % 3] * spread + rng.standard_normal(6) * spread / 4).astype(float).tolist()) for i in range(n)] + [(None, [0.0] * 6)]
        rows += [(1000 + i, rows[0][1]) for i in range(10)]
        got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), hashed(), k=k, dims=6).collect()
        want, cents = _clusters(rows, k, 5)
        assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=repr) == want
        for r in got:
            assert r.centroid == cents[r.cluster] and r.inertia == sum(x[2] for x in want)
            assert r.cluster_inertia == sum(x[2] for x in want if x[1] == r.cluster)


def test_centroids_on_odd_inputs(spark):
    schema = "vec_id long, embedding array<float>, id string, cluster string, v string"
    rows = [(1, None, "a", "b", "c"), (2, [1.0, None], "a", "b", "c"), (3, [float("nan"), 0.0], None, "b", "c"), (4, [0.5, 1.0], "a", None, "c"), (4, [0.5, 1.0], "a", "b", None), (5, [1.0], "a", "b", "c"), (6, [], "a", "b", "c"), (7, [-3.0, 2.0], "a", "b", "c")]
    got = centroids.cluster(spark.createDataFrame(rows, schema), hashed(), k=2, dims=2).collect()
    assert sorted(r.vec_id for r in got) == [4, 4, 7]
    assert centroids.cluster(spark.createDataFrame([], schema), hashed(), dims=2).count() == 0
    assert centroids.cluster(spark.createDataFrame(rows[:3], schema), hashed(), dims=2).collect() == []
    with pytest.raises(Exception, match="or more"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>"), hashed(), dims=2)
