"""The operators against brute force, public libraries and SQL, on small inputs."""

import hashlib
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import pytest
import public_tokenizers as P

import corpus_pipeline
from verseloom.llm import byte_bpe, embedding_dedup, html_extract, licenses, packing, quality_model, quality_rules
from verseloom.llm import queries, simhash, token_counts, toxicity
from verseloom.llm.components import Forest, connected_components

SF = "/root/testdata/sf0.01"
WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "\n\n", "a", "İ? Σ. ÉCOLE don't", "x" * 300, "<|endoftext|> a<|endoftext|>.", "日本 \x00\x85\x1c", "a  b\n \n c  "]
KIND = "text string, doc_id long, fp int, key int, n_words int, score string, `a b` string"


@pytest.fixture(scope="module")
def texts():
    found = duckdb.connect().sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 300").df()["text"].tolist()
    return found + ODD


def odd_docs(spark):
    rows = [(t, k, 1, 2, 3, "x", None) for k, t in enumerate(ODD)] + [("same text", 50, 1, 1, 1, "", ""), ("same text", 50, 1, 1, 1, "", ""), ("no id", None, 1, 1, 1, "", "")]
    return spark.createDataFrame(rows, KIND)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op7_embedding_dedup"])
def test_sql_twin(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, SF).toPandas()
    theirs = db.sql(queries.ORACLE_SQL[name]).df()[ours.columns]
    key = ours.columns[0]
    assert ours.sort_values(key).values.tolist() == theirs.sort_values(key).values.tolist()


OPERATORS = {
    "rules": quality_rules.judge,
    "simhash": simhash.near_duplicates,
    "counts": lambda d: token_counts.token_counts(d, WORDS),
    "model": quality_model.classify,
    "bytes": lambda d: byte_bpe.round_trip(d, BYTES, P.PATTERN),
    "toxicity": lambda d: toxicity.score(d, toxicity.Model({"w:bad": 20.0}, -8.0)),
    "packing": lambda d: packing.pack(d, WORDS),
    "licenses": licenses.scan,
    "kept by rules": quality_rules.filter_documents,
    "kept by model": quality_model.filter_documents,
    "kept by simhash": simhash.deduplicate,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    docs = odd_docs(spark)
    found = OPERATORS[name](docs)
    n = found.count()
    assert 0 <= n <= docs.count() if name.startswith("kept") else n == docs.count()
    assert OPERATORS[name](docs.limit(0)).count() == 0
    if name.startswith("kept"):
        assert found.columns == docs.columns


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)]
    forest = Forest()
    for a, b in pairs:
        forest.add(a, b)
    got = connected_components(spark.createDataFrame([*pairs, (5, None)], "a long, b long").repartition(7)).collect()
    assert {r["node"]: r["component"] for r in got} == {x: forest.find(x) for p in pairs if p[0] != p[1] for x in p}


@pytest.mark.parametrize("block", [20_000, 8])
def test_simhash_equals_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 12)
    prints = [int(b) for b in base]
    for b in base.tolist():
        for _ in range(40):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            x = np.uint64(b & (2**64 - 1))
            for f in flips:
                x ^= np.uint64(1 << int(f))
            prints.append(int(x.astype(np.int64)))
    prints = sorted(set(prints))
    forest = Forest()
    u = np.array(prints, dtype=np.int64).view(np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 4) + i + 1:
            forest.add(prints[i], prints[j])
    got = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in prints], "fp long"), block=block).collect()
    found = {r["node"]: r["component"] for r in got}
    assert {p: found.get(p, p) for p in prints} == {p: forest.find(p) for p in prints}


def test_large_bucket_links():
    rng = np.random.default_rng(1)
    prints = np.unique(np.concatenate([np.uint64(c) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for c in rng.integers(0, 2**62, 5)]))
    a, b = Forest(), Forest()
    for i, j in simhash._link_large(prints, 4):
        assert np.bitwise_count(prints[i] ^ prints[j]) <= 4
        a.add(int(i), int(j))
    for i in range(len(prints)):
        for j in range(i):
            if np.bitwise_count(prints[i] ^ prints[j]) <= 4:
                b.add(i, j)
    assert [a.find(k) for k in range(len(prints))] == [b.find(k) for k in range(len(prints))]


def test_token_counts_equal_library(texts):
    from tokenizers import Tokenizer

    library, known = Tokenizer.from_file(WORDS), token_counts.counter(WORDS)
    assert [known.tokens(t) for t in texts] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_packing_ids_equal_library(texts):
    from tokenizers import Tokenizer

    library, known = Tokenizer.from_file(WORDS), packing.encoder(WORDS)
    more = ["don't we'll 'sx a's…¼²ª", "ß\xa0x\x85y z", "a" * 5000, "..,, x.,y A.B. ,", "\t\ttab\tx\r\n", "ǅabc ŉ K."]
    for t, ids in zip(texts + more, known.encode(texts + more), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_byte_bpe_equals_library(texts):
    import tiktoken

    known = byte_bpe.codec(BYTES, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=known.ranks, special_tokens={})
    for t in texts:
        ids = known.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t or "")
        assert known.decode(ids) == (t or "")


def test_stream_decoder_replaces_wrong_bytes():
    decoder = byte_bpe.StreamDecoder({k: bytes((k,)) for k in range(256)})
    rng = np.random.default_rng(0)
    for _ in range(300):
        data = rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0xFF, 0xED, 0xA0], 8).astype(np.uint8).tobytes()
        assert decoder.decode(list(data)) == data.decode(errors="replace")


def test_packing_is_whole_and_gapless(spark):
    got = packing.op9_packing(spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    run = got.groupby("sequence_id")["length"].cumsum() - got["length"]
    assert (run == got["offset"]).all() and got.groupby("sequence_id")["length"].sum().max() <= 4096
    assert got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 4096 + 1


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(by):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 90, 400).tolist()
    bins, offsets = packing.best_fit(sizes, 100, 4, 6000, (1.0, 0.5, 0.5), by)
    frame = pd.DataFrame({"b": bins, "o": offsets, "n": sizes, "a": [min(n * n, 6000) for n in sizes]}).sort_values(["b", "o"])
    sums = frame.groupby("b").agg(n=("n", "sum"), d=("n", "size"), a=("a", "sum"))
    assert sums["n"].max() <= 100 and sums["d"].max() <= 4 and sums["a"].max() <= 6000
    assert (frame.groupby("b")["n"].cumsum() - frame["n"] == frame["o"]).all()


def test_embeddings_odd_vectors_and_blocks(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(k, (centre + rng.standard_normal(16) * 0.05 * (k % 4)).tolist(), k % 2) for k in range(80)]
    rows += [(80, None, 1), (81, [0.0] * 16, 1), (82, [float("nan")] * 16, 1), (83, [1.0, None], 1), (84, centre.tolist(), None), (85, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    n, forest = dict.fromkeys(range(86), 0), Forest()
    for i in range(80):
        for j in range(i):
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if rows[i][2] == rows[j][2] and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                n[i] += 1
                n[j] += 1
                forest.add(i, j)
    for block in (2000, 7):
        got = embedding_dedup.near_duplicates(frame, missed=1e-9, block=block).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {
            k: (n[k], forest.find(k), forest.find(k) == k) for k in range(86)
        }


def test_toxicity_on_held_out(spark):
    found = toxicity.op6_toxicity(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    test = found[found["held_out"]]
    wrong, right = test[test["toxic"] == 0], test[test["toxic"] == 1]
    assert wrong["predicted"].mean() <= 0.02 and right["predicted"].mean() >= 0.5
    ahead = (right["score"].values[:, None] > wrong["score"].values).mean() + (right["score"].values[:, None] == wrong["score"].values).mean() / 2
    assert ahead >= 0.8  # the chance that a toxic document ranks above a clean one


def test_toxicity_from_few_labels(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.weights and max(model.weights.values()) > 1
    assert toxicity.fit(docs, labels.where("toxic = 1")).weights == toxicity.fit(docs.limit(0), labels).weights == {}


def test_toxicity_fit_is_the_same_for_any_order(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    some = [toxicity.fit(docs.repartition(n), labels, field_rows=30) for n in (1, 7)]
    assert some[0].weights == some[1].weights and some[0].bias == some[1].bias and some[0].moves == some[1].moves


def test_objective_equals_enumeration_and_its_gradient_differences():
    from itertools import product

    texts = [(1, 5, [1, 3], [[0], [0, 1]]), (0, 4, [0], [[1]]), (1, 2, [], []), (0, 6, [1, 2], [[0], [1]])]
    data = toxicity.Chains(texts, 2)
    weight = np.array([1.0, 0.5, 2.0, 1.5])
    theta = np.array([1.2, -0.4, -1.1, 0.3, -0.2, 0.1, 0.6, -1.3])
    moves, wrong = theta[3:7].reshape(2, 2), 1 / (1 + np.exp(-theta[7]))
    expected = 0.0
    for (toxic, n, at, ids), w in zip(texts, weight):
        emit = [theta[2] + sum(theta[i] for k, x in zip(at, ids) if k == j for i in x) for j in range(n)]
        total = sum(np.exp(sum(moves[a, b] for a, b in zip((0, *t), t)) + np.dot(t, emit)) for t in product((0, 1), repeat=n))
        none = (1 - wrong) * np.exp(n * moves[0, 0]) / total
        expected += w * np.log(1 - none if toxic else none)
    value, grad = toxicity.objective(theta, data, weight)
    assert np.isclose(value, expected)
    for k in range(len(theta)):
        step = np.eye(len(theta))[k] * 1e-6
        slope = (toxicity.objective(theta + step, data, weight)[0] - toxicity.objective(theta - step, data, weight)[0]) / 2e-6
        assert np.isclose(slope, grad[k], atol=1e-6)


def test_toxicity_of_long_and_neighbouring_words():
    model = toxicity.Model({"w:bad": 6.0, "p:so": 4.0, "n:word": 4.0}, -8.0)
    assert model.score("so bad word") > 0.9 > 0.5 > model.score("bad") > 0 == model.score("") == model.score(None)
    assert model.spans("x so bad word y") == [(5, 8)]
    long = "filler " * 200_000 + "so bad word"
    assert model.spans(long) == [(len(long) - 8, len(long) - 5)]


def test_chains_hold_every_word():
    texts = [(1, 1000, [5, 999], [[0], [0]]), (0, 64, [], []), (0, 65, [64], [[0]]), (1, 3, [], [])]
    data = toxicity.Chains(texts, 1)
    assert np.bincount(data.doc, data.times * data.lengths[data.chain]).tolist() == [1000, 64, 65, 3]


def test_crf_marginals_equal_enumeration():
    from itertools import product

    model = toxicity.Model({"w:bad": 3.0, "w:mad": 2.0}, -1.5, ((0.2, -0.4), (0.1, 0.7)))
    words = ["a", "bad", "b", "c", "mad", "bad", "d"]
    emit = [model.bias + model.memo[w] for w in words]
    weights = {}
    for tags in product((0, 1), repeat=len(words)):
        x = sum(e for e, t in zip(emit, tags) if t) + sum(model.moves[a][b] for a, b in zip((0, *tags), tags))
        weights[tags] = np.exp(x)
    total = sum(weights.values())
    at, p = model.marginals(words)
    assert at.tolist() == [1, 4, 5]
    assert np.allclose(p, [sum(v for t, v in weights.items() if t[k]) / total for k in at])


def test_quality_classifier_on_labels(spark):
    found = quality_model.op4_quality_classifier(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert found[found["quality"] == 1]["kept"].mean() >= 0.97
    assert found[found["quality"] == 0]["kept"].mean() <= 0.1


def test_html():
    page = (
        "<html><head><title>x</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div>"
        "<article><h1>Head &amp; line</h1><p>First  long\n paragraph, with <i>marks</i>.<p><b>Second one.<br><ul><li>point</ul>"
        "<div class=comments><p>Nice!</p></div><script>var a='</p>'</script><form><p>Mail</p></form></article>"
        "<aside>More</aside><footer>&copy; me</footer></body></html>"
    )
    assert html_extract.extract_text(page) == "Head & line\n\nFirst long paragraph, with marks.\n\nSecond one.\n\npoint"
    assert html_extract.extract_text(None) == html_extract.extract_text("") == ""
    assert html_extract.extract_text("<p>cut off <b") .startswith("cut off")


def test_licenses():
    words = licenses.words_of("Under the MIT License. MIT LICENSE mit license; CC-BY x")
    assert licenses.phrase_places(words, licenses.PHRASES) == [(2, "mit"), (4, "mit"), (6, "mit"), (8, "cc-by")]
    index = licenses.Index(licenses.TEMPLATES, {}, 10)
    text = "x y This work is licensed under the GNU General Public License, version 3. and more"
    assert "gpl-3.0" in index.notices(licenses.words_of(text))
    assert index.notices(licenses.words_of("this work is under way and the source is free")) == {}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns
        got = kept.toPandas()
        assert got["doc_id"].is_unique and (ids is None or set(got["doc_id"]) <= ids)
        ids = set(got["doc_id"])
        docs = spark.createDataFrame(got, docs.schema)
    assert set(corpus_pipeline.run(spark, SF).toPandas()["doc_id"]) == ids


def test_digests(spark):
    got = byte_bpe.round_trip(odd_docs(spark).limit(10), BYTES, P.PATTERN).toPandas()
    for r in got.itertuples():
        assert r.decoded_sha256 == hashlib.sha256((ODD[int(r.doc_id)] or "").encode()).hexdigest()


def test_held_out_split(spark):
    got = spark.range(30).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r["h"] == (crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
