"""The pipeline's stages, and the operators that SQL cannot express, against plain versions."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from veriflux.llm import langid, mixing, toxicity

from .test_brute_force import components, learnable, lower_az, shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_score(model, text):
    """Toxicity by the definition: every weight whose word, or beginning of 3 to 7 letters, some word of the text has."""
    have = set()
    for word in toxicity.LETTERS.findall((text or "").lower()):
        have.add(word)
        have.update("^" + word[:n] for n in range(3, 8) if n < len(word))
    return 1 / (1 + math.exp(-(model.bias + sum(w for p, w in model.weights.items() if p in have))))


def test_toxicity_scores_by_definition(spark):
    docs = learnable(300) + [(900, None, "en", 0), (901, "", "en", 0), (902, "word " * 30_000 + "scumbag", "en", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    assert model.weights
    got = {r.doc_id: r.score for r in toxicity.toxicity(df, df.select("doc_id", "toxic")).collect()}
    for i, text, _, _ in docs:
        assert got[i] == pytest.approx(plain_score(model, text), rel=1e-6)


def test_a_score_of_one_half_is_toxic(spark):
    model = toxicity.Model({}, 0.0, [], np.zeros((2, 0)), np.zeros((0, 0)))
    batches = list(toxicity.score_all(model)(spark.createDataFrame([(1, "a", False)], "doc_id long, text string, held_out boolean").toArrow().to_batches()))
    assert batches[0].to_pylist() == [{"doc_id": 1, "held_out": False, "score": 0.5, "predicted": 1}]


def test_label_model_by_hand():
    votes = np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [0, 1, 0], [1, 0, 0], [0, 0, 0], [0, 0, 1]], np.int8)
    labels, weight = votes[:, 2].astype(float), np.array([1.0, 1, 1, 2, 1, 1, 1])
    n, m = votes.shape
    post, share = [0.95 if y else 0.05 for y in labels], [1.0] * m
    for step in range(toxicity.EM_ROUNDS):
        rates = [[(sum(weight[i] * q(post[i]) * votes[i, j] for i in range(n)) + 0.5) / (sum(weight[i] * q(post[i]) for i in range(n)) + 1) for j in range(m)] for q in (lambda p: 1 - p, lambda p: p)]
        prior = min(max(sum(w * p for w, p in zip(weight, post)) / sum(weight), 1e-4), 1 - 1e-4)
        if step % 5 == 0:
            rest = [[(votes[i, j] - post[i] * rates[1][j] - (1 - post[i]) * rates[0][j]) * math.sqrt(weight[i]) for j in range(m)] for i in range(n)]
            cov = [[sum(r[a] * r[b] for r in rest) for b in range(m)] for a in range(m)]
            scale = [math.sqrt(max(cov[a][a], 1e-9)) for a in range(m)]
            corr = [[cov[a][b] / scale[a] / scale[b] for b in range(m)] for a in range(m)]
            share = [min(max(1 / (1 + sum(max(corr[a][b] - (a == b), 0.1) for b in range(m)) - 0.1 * m), 0.05), 1) for a in range(m)]
        for i in range(n):
            logit = math.log(prior / (1 - prior))
            for j in range(m):
                p0, p1 = (rates[0][j], rates[1][j]) if votes[i, j] else (1 - rates[0][j], 1 - rates[1][j])
                logit += share[j] * math.log(p1 / p0)
            post[i] = 1 / (1 + math.exp(-min(max(logit, -30), 30)))
    posterior, found, _ = toxicity.label_model(votes, labels, weight)
    assert posterior == pytest.approx(post, rel=1e-6) and found == pytest.approx(np.array(rates), rel=1e-6)


def test_language_is_the_smallest_encoding(spark):
    docs = learnable(200) + [(700, "the " * 9000, "en", 0), (701, "12 34", "en", 0), (702, None, "de", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic int")
    dictionaries = langid.fit(df)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    for i, text, _, _ in docs:
        body = " ".join(langid.LETTERS.findall((text or "").lower())).encode()
        sizes = {}
        for lang, content in dictionaries.items():
            coder = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(body[k : k + langid.PIECE])) for k in range(0, len(body), langid.PIECE))
        assert got[i].lang_pred == (min(sorted(sizes), key=sizes.get) if body else "und")


def test_equal_sizes_go_to_the_first_language():
    same = b"one dictionary for both languages " * 20
    lang, score, margin, rejected = langid.Classifier({"b": same, "a": same})("languages for both")
    assert (lang, score, margin, rejected) == ("b", 0.5, 0.0, True)  # fit() gives languages in order of their names
    assert langid.Classifier(dict(sorted({"b": same, "a": same}.items())))("languages for both")[0] == "a"


def test_samples_reach_the_end_of_long_texts_and_count_a_repeated_id_once(spark):
    text = "alpha " * 4000 + "omega " * 4000
    docs = [(4, text, "en")] * 60 + [(5, "beta " * 20, "en")]
    found = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4))["en"]
    assert b"alpha" in found and b"omega" in found and len(found) < 10_000
    marked = spark.createDataFrame([(4, 1), (5, 0), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame([*docs, (7, "gamma", "en")], "doc_id long, text string, lang string"), marked)
    assert model.bias < 40  # 60 rows of document 4 are one toxic document


def plain_mix(spark, df, seed=7):
    """What each (doc_id, text) gives: sort a source by place, and cut it where its target ends."""
    rows = df.select("doc_id", "text", "source", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)).alias("place")).collect()
    size = {(r.doc_id, r.text): len([w for w in (r.text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]) for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r.source] += size[r.doc_id, r.text]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, fixed = {}, {}
    while True:
        rest = 1.5 * sum(total.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        target = {**fixed, **{s: rest * weight[s] / sum(weight[x] for x in free) for s in free}}
        over = [s for s in free if target[s] > 2 * total[s]]
        if not over:
            break
        fixed |= {s: 2.0 * total[s] for s in over}
    taken = {}
    for s in order:
        whole = min(int(target[s] // total[s]), 2) if total[s] else 0
        left = round(target[s] - whole * total[s]) if whole < 2 else 0
        for r in sorted((r for r in rows if r.source == s), key=lambda r: r.place % (1 << 64)):
            words = size[r.doc_id, r.text]
            taken[r.doc_id, r.text] = whole * words + min(words, left)
            left -= min(words, left)
    return target, taken


def test_mixing_cuts_sorted_sources(spark):
    rng = random.Random(17)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 60)) + f" t{i}", rng.choice(["a", "b", "é", None])) for i in range(300)]
    docs += [(None, f"u{i} v w", "z") for i in range(50)] + [(None, "x " * 3000, "z")]  # null ids of very different sizes
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    target, taken = plain_mix(spark, df)
    for r in mixing.mix(df).collect():
        assert r.target == pytest.approx(target[r.source])
    got = collections.Counter()
    for r in mixing.mix(df).collect():
        got[r.source] += r.taken
    assert all(abs(got[s] - target[s]) <= 1 for s in target)
    texts = {d: t for d, t, _ in docs if d is not None}
    for r in mixing.mix(df).where("doc_id is not null").collect():
        assert r.taken == taken[r.doc_id, texts[r.doc_id]]


def test_many_sources_and_several_trees(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TREE_SOURCES", 40)
    rng = random.Random(23)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 9)), f"s{i % 333:03d}" if i % 50 else None) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    target, taken = plain_mix(spark, df)
    got = mixing.mix(df).collect()
    assert len(target) == 334 and {(r.doc_id, r.taken) for r in got} == {(i, n) for (i, _), n in taken.items()}
    assert all(r.target == pytest.approx(target[r.source]) for r in got)


def test_stages_against_plain_versions(spark, tmp_path):
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    base = [words(rng.randrange(20, 90)) for _ in range(15)]
    docs = []
    for i in range(240):
        text = list(rng.choice(base)) if i % 2 else words(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 4) if i % 4 == 1 else 0):
            text[rng.randrange(len(text))] = f"n{i}"
        if i % 9 == 0:
            text.insert(len(text) // 2, rng.choice(["scumbag", "moron"]))
        docs.append((i, " ".join(text).title() if i % 10 == 3 else " ".join(text), "en", rng.choice(["a", "b", None]), 1))
    docs += [docs[5], docs[5], (None, docs[7][1], "en", "a", 1), (300, None, None, None, None), (301, "", None, "b", 0)]
    toxic = {d[0]: int(any(w in (d[1] or "").lower() for w in ("scumbag", "moron"))) for d in docs if d[0] is not None}
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows, stage = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)

    def run(name, given):
        stage[name](spark, given, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        return out, [(r.doc_id, r.text) for r in out.collect()] if "text" in out.columns else out.collect()

    model = toxicity.fit(rows, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = [(d[0], d[1]) for d in docs if plain_score(model, d[1]) < 0.5]
    rows, clean = run("toxicity", rows)
    assert sorted(clean, key=repr) == sorted(want, key=repr) and len(want) < len(docs)

    best = {}
    for i, t in clean:
        k = lower_az(t)
        best[k] = max((i, t) if i is not None else (-1, t), best.get(k, (-1, t)), key=lambda x: x[0])
    rows, single = run("exact_dedup", rows)
    assert sorted((i, lower_az(t)) for i, t in single) == sorted((i, k) for k, (i, _) in best.items())

    sets = {i: shingle_set(t) for i, t in single}
    low = components(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    rows, apart = run("minhash_dedup", rows)
    assert sorted(i for i, _ in apart) == sorted(i for i in sets if low[i] == i) and len(apart) < len(single)

    target, taken = plain_mix(spark, rows)
    rows, mixed = run("mixing", rows)
    got = collections.Counter()
    for i, t in mixed:
        got[i] += len((t or "").split())
    assert {i: n for i, n in got.items() if n} == {i: n for (i, _), n in taken.items() if n}

    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    ids = [np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in mixed]
    _, pieces = run("packing", rows)
    want = collections.Counter(zlib.crc32(x[k : k + 1024].tobytes()) for x in ids for k in range(0, len(x), 1024))
    assert collections.Counter(p.ids_crc32 for p in pieces) == want
    places = collections.defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
    for s in map(sorted, places.values()):
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 1024

