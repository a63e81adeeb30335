"""Each operator against a plain version of itself."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from veriflux.llm import embedding_dedup, exact_dedup, langid, minhash, mixing, packing, secrets, suffix_dedup, token_counts, toxicity

from veriflux.llm.common import likely

from . import cases


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Documents with exact copies, near copies of several degrees, shared passages and short texts."""
    rng, docs = random.Random(11), []
    passage = " ".join(words(rng, 60))
    bases = [words(rng, rng.randrange(30, 120)) for _ in range(12)]
    for i in range(260):
        kind = i % 5
        text = list(rng.choice(bases)) if kind < 3 else words(rng, rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 6) if kind in (1, 2) else 0):
            text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
        text = " ".join(text)
        if i % 7 == 0:
            text = text[: len(text) // 2] + " " + passage + text[len(text) // 2 :]
        docs.append((i, text.title() if i % 11 == 0 else text))
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


def components(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup(spark, corpus):
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups[lower_az(t)].append(i)
    want = sorted((i, max(groups[lower_az(t)]), len(groups[lower_az(t)]), i == max(groups[lower_az(t)]), hashlib.sha256(lower_az(t).encode()).hexdigest()) for i, t in corpus)
    for entries in (1, 64):
        assert cases.result(exact_dedup.exact_dedup(frame(spark, corpus), entries)) == sorted(want, key=repr)


def test_equal_hashes_of_different_texts_stay_apart():
    rows = [[1, 1, 1, 1], [10, 11, 12, 13], [b"a", b"b", b"a", b"c"], [2, 1, 3, 1], [5, 6, 9, None]]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["key", "entry", "body", "n", "doc_id"])
    got = {r["entry"]: (r["keep_id"], r["group_size"]) for b in exact_dedup.own([batch]) for r in b.to_pylist()}
    assert got == {10: (9, 5), 12: (9, 5), 11: (6, 1), 13: (None, 1)}


def test_directory_splits_overfull_buckets():
    loads = np.zeros(16, np.int64)
    loads[3], loads[2], loads[12] = 9, 3, 4
    bucket, depth = exact_dedup.directory(loads, 10)
    assert depth == 4 and bucket[12] != bucket[3] != bucket[2]
    assert max(loads[bucket == b].sum() for b in set(bucket.tolist())) <= 10


def test_owners_take_key_ranges_of_even_load():
    rng = np.random.default_rng(2)
    loads = rng.integers(0, 9, 1 << 18)  # deeper than 16 bits
    loads[77] = 4000
    bucket, depth = exact_dedup.directory(loads, 20)
    owner = exact_dedup.owners(bucket, loads, 40)
    assert depth > 16 and (np.diff(owner) >= 0).all() and owner.max() == 39
    assert all(len(set(owner[bucket == b].tolist())) == 1 for b in bucket[:: 1 << 12])
    assert np.bincount(owner, loads).max() < loads.sum() / 40 + 4100


def shingle_set(text):
    w = lower_az(text).split()
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("small,block,rows", [(6, 2048, 16_384), (2, 3, 16_384), (2, 3, 20)])
def test_minhash(spark, corpus, monkeypatch, small, block, rows):
    monkeypatch.setattr(minhash, "INDEX_ROWS", rows)
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    sets = {i: shingle_set(t) for i, t in corpus}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = components(sets, linked)
    assert len(linked) > 200
    assert cases.result(minhash.minhash_dedup(frame(spark, corpus))) == sorted(((i, len(s), low[i], low[i] == i) for i, s in sets.items()), key=repr)


def without_repeats(docs):
    first, want = {}, []
    for i, t in sorted(docs):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        want.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(want, key=repr)


@pytest.mark.parametrize("many,sorted_", [(400, 100_000), (2, 50)])
def test_suffix_dedup(spark, corpus, monkeypatch, many, sorted_):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 2)
    monkeypatch.setattr(suffix_dedup, "SORTED", sorted_)
    rng = random.Random(21)
    # a third of the documents share 20 bytes with different surroundings, some of these more
    head, more = "http://example.org/a", [" ".join(words(rng, 8)) for _ in range(6)]
    shared = [(1000 + i, " ".join([*words(rng, 6), rng.choice(more) + head + rng.choice([*more, f"{rng.random()}" * 3]), *words(rng, 9)])) for i in range(130)]
    docs = [*corpus, *shared, (5000, "ab" * 700), (5001, "é" * 40 + "ab" * 90), (5002, "x" * 49), (5003, "x" * 50)]
    want = without_repeats(docs)
    assert cases.result(suffix_dedup.remove_repeats(frame(spark, docs))) == want
    assert sum(w[2] for w in want) > 10_000


def test_hot_triggers_are_found(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 50)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    rng = random.Random(4)
    texts = [(i, f"{rng.random()}" * 4 + "the same forty characters in every text " + f"{rng.random()}" * 4) for i in range(200)]
    hot = suffix_dedup.hot_triggers(frame(spark, texts))
    marked = sum(int(w).bit_count() for w in hot)  # a bit for each hot trigger
    assert 1 <= marked <= 40


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 16))
    vectors = [(i, [float(x) for x in np.float32(centres[rng.integers(9)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.35]))], int(rng.integers(3)) if i % 17 else None) for i in range(300)]
    exact = {i: np.array(v, np.float32).astype(float) for i, v, _ in vectors}
    label = {i: c for i, _, c in vectors}
    linked = [(a, b) for a in exact for b in exact if a < b and label[a] is not None and label[a] == label[b] and exact[a] @ exact[b] / np.sqrt(exact[a] @ exact[a]) / np.sqrt(exact[b] @ exact[b]) >= 0.93]
    low, n = components(exact, linked), collections.Counter(x for p in linked for x in p)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(4)
    for block in (16, 1024):
        assert cases.result(embedding_dedup.embedding_dedup(df, block=block)) == sorted(((i, n[i], low[i], low[i] == i) for i in exact), key=repr)


def test_int8_bounds_hide_nothing():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(200, 24)), rng.normal(size=(150, 24))
    b[:60] = a[:60] + rng.normal(size=(60, 24)) * 0.4
    sure, open_ = embedding_dedup.bounded(embedding_dedup.quantise(embedding_dedup.unit(a)), embedding_dedup.quantise(embedding_dedup.unit(b)), False, 0.9)
    cos = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    assert sure.any() and open_.any() and (cos[sure] >= 0.9).all() and (cos[~(sure | open_)] < 0.9).all()


def test_secret_spans(spark):
    texts = [
        "token = 'abcdef' and Password:short api-key=zzzzzz apikey=abcdefg", "secret: token:abcdefgh", "AKIA" + "A" * 16 + " AKIAB " + "ab12" * 6 + "é" + "ff" * 12, "ü😀 passwd=abc.def/ghi token=",
        "ghp_" + "a1" * 18 + " xoxb-1234567890ab -----BEGIN RSA PRIVATE KEY----- eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh12", "AKIA" + "Z9" * 30, "API_KEY  =  " + "0a" * 20, "", None,
        " ".join(f"é{'0123456789abcdef' * 2} token=abc{i:05d}" for i in range(700)),
    ]
    base = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    more = [(r.kind, re.compile(r.pattern), 0, 0) for r in secrets.RULES if not r.base]

    def spans(text, rules):
        found = [(m.start(), o, f"{k}:{m.start()}:{m.end()}") for o, (k, p, g, n) in enumerate(rules) for m in p.finditer(text or "") if len(m[g]) >= n]
        return [x[2] for x in sorted(found)]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(df).collect():
        want = spans(texts[r.doc_id], base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k, *_ in base]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.spans == ",".join(spans(texts[r.doc_id], base + more))


def test_bitmap_of_ids_hides_none(spark):
    rows = spark.createDataFrame([(i if i else None, f"t{i}") for i in range(2000)], "doc_id long, text string")
    ids = spark.createDataFrame([(i if i else None,) for i in range(0, 2000, 40)], "doc_id long")
    got = {r.text: r.likely for r in likely(rows, ids).collect()}
    assert len(got) == 2000 and all(got[f"t{i}"] for i in range(0, 2000, 40)) and sum(got.values()) < 120
    assert not any(r.likely for r in likely(rows, ids.limit(0)).collect())


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] is None
    assert q["access"] == frozenset([frozenset(["aki", "kia"])])
    assert frozenset(["tok", "oke", "ken"]) in q["assign"] and len(q["assign"]) == 6
    assert all(t in "-----begin " or t in "private key-----" for o in q["private_key"] for t in o)


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(words(rng, rng.randrange(0, 80))), rng.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(7)).collect()))
    size = {i: len(t.split()) for i, t, _ in docs}
    total = collections.Counter()
    for i, t, s in docs:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([total[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))])))
    taken = collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and len(r.shards) == r.epochs + (r.rest > 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)
    assert abs(sum(want.values()) - 1.5 * sum(size.values())) < 1e-6
    mixed = mixing.mixture(df).collect()
    assert sum(r.words for r in mixed) == sum(taken.values())


def test_pipeline_mix_gives_the_words_of_the_targets(spark):
    import corpus_pipeline

    rng = random.Random(5)
    texts = {i: "\n " * (i % 2) + "  ".join(words(rng, rng.choice([0, 7, 900]))) + " " * (i % 3) for i in range(60)}
    df = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.mix_sources(spark, df, "").collect()
    taken, size = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        size["ab"[i % 2]] += len(t.split())
    for r in got:
        taken[r.source] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    want = mixing.targets([size["a"], size["b"]], [3, 1])
    assert all(abs(taken[s] - w) <= 1 for s, w in zip("ab", want))
    assert [(r.doc_id, len(r.text.split())) for r in got] == [(r.doc_id, r.words) for r in mixing.mixture(df).collect()]


def test_targets_share_the_excess():
    assert mixing.targets([10, 100, 100], [3, 1, 2]) == [20.0, pytest.approx(295 / 3), pytest.approx(590 / 3)]
    assert mixing.targets([], []) == []


def test_splitting_tree_adds_up():
    quotas = np.array([1000, 0, 37, 4])
    parts = mixing.splitting_tree(quotas, 7, 3)
    assert parts.shape == (7, 4) and (parts.sum(0) == quotas).all() and parts.min() >= 0
    assert abs(parts.sum(1) - quotas.sum() / 7).max() < 2


def test_packing_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    docs = [*corpus, (1000, "<|endoftext|> is a text"), (1001, None), (1002, "漢字 and 😀 " * 50), *((2000 + i, " ".join(words(rng, 900))) for i in range(6))]
    got = packing.pack(frame(spark, docs)).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, p in pieces.items():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(n for _, n in p) == len(ids[i])
    assert pieces.keys() == ids.keys() and sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 1024
    assert len(sequences) <= sum(map(len, ids.values())) / 1024 * 1.05 + 1


def test_fast_ids_equal_the_tokenizer_file():
    from tokenizers import Tokenizer

    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    letters = [chr(c) for c in range(1, 0x250)]
    for i in range(3000):
        text = "".join(rng.choices(letters, k=rng.randrange(1, 30))) if i % 2 else " ".join(rng.choices(["It's", "we'll", "don't", "12", "\n", " ", "\t\r", "é", "x", ";;", "\x85", "\xa0", "\x1c"], k=12))
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables are not here")
def test_fast_ids_equal_the_tokenizer_file_on_all_documents():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, exact = packing.encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"), packing.special_tokens(path)), Tokenizer.from_file(path)
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        assert encode(text or "").tolist() == exact.encode(text or "", add_special_tokens=False).ids


def test_shortest_pack_first_uses_every_piece():
    rng = np.random.default_rng(1)
    counts = np.zeros(1025, np.int64)
    for n in rng.integers(1, 1024, 3000):
        counts[n] += 1
    patterns = packing.shortest_pack_first(counts, 1024)
    back = np.zeros(1025, np.int64)
    for c, lengths in patterns:
        assert sum(lengths) <= 1024 and c > 0
        for n in lengths:
            back[n] += c
    assert (back == counts).all()


def test_token_counts_follow_unigram(spark):
    from tokenizers import Tokenizer, models

    scores, _ = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    other = Tokenizer(models.Unigram([("<unk>", -1000.0), *scores.items()], unk_id=0, byte_fallback=False))
    texts = ["the quick brown fox jumps", "unbelievable transformations of tokenization", "aaaaaaaaaaaaaaaa", "", None, "Donaudampfschifffahrt   gesellschaft\n\tEnde", "x" * 300]
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        parts = (t or "").split()
        assert got[i] == (len(parts), sum(len(other.encode(token_counts.MARK + p).ids) for p in parts))


def test_trie_counts_equal_those_of_single_words():
    scores = {token_counts.MARK: -5.0, "a": -2.0, "b": -2.0, "ab": -2.5, "abab": -3.0, token_counts.MARK + "a": -3.0}
    pieces, rng = token_counts.Pieces(scores, -20.0), random.Random(9)
    big, tiny = token_counts.Counter(pieces), token_counts.Counter(pieces, 3)
    tokens = ["".join(rng.choices("abé漢😀\ud800", weights=[9, 9, 1, 1, 1, 1], k=rng.randrange(1, 90))) for _ in range(400)]
    big.learn(set(tokens))
    for w in tokens:
        tiny.learn({w})
        best = [(0.0, 0)]
        full = token_counts.MARK + w
        for end in range(1, len(full) + 1):
            options = [(best[s][0] + scores[full[s:end]], best[s][1] - 1) for s in range(end) if full[s:end] in scores]
            if full[end - 1] not in scores:
                n = len(full[end - 1].encode("utf-8", "replace"))
                options.append((best[end - 1][0] - 20.0 * n, best[end - 1][1] - n))
            best.append(max(options))
        assert big.count(w) == tiny.count(w) == token_counts.count_one(full, pieces) == -best[-1][1]


def learnable(n=600):
    rng, docs = random.Random(13), []
    stems = {"en": ["the", "wh", "th", "ing"], "de": ["sch", "ein", "ung", "keit"], "fr": ["eau", "oux", "tion", "ère"]}
    for i in range(n):
        lang = rng.choice(list(stems))
        text = [rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(rng.randrange(20, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["moron", "scumbag", "vequ" + rng.choice("abcdef") + "x"])
        docs.append((i, " ".join(text), lang, int(toxic)))
    return docs


def test_language_on_held_out_documents(spark):
    docs = learnable()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic int")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert all(got[d[0]].held_out == (d in held) and 0 <= got[d[0]].score <= 1 for d in docs)
    assert sum(got[d[0]].lang_pred == d[2] for d in held) >= 0.97 * len(held)
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "12 34", "en"), (2, None, "en"), (3, "the thing", "en")], "doc_id long, text string, lang string")).collect()} >= {"und"}


def test_toxicity_on_held_out_documents(spark):
    docs = learnable()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert all(got[d[0]].held_out == (d in held) and got[d[0]].predicted == (got[d[0]].score >= 0.5) for d in docs)
    assert sum(got[d[0]].predicted == d[3] for d in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in toxicity.keep_clean(df, df.select("doc_id", "toxic")).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_label_model_sees_through_a_wrong_label_and_an_echo():
    rng = np.random.default_rng(5)
    y = rng.random(800) < 0.3
    a, b, c = ((y & (rng.random(800) < p)).astype(np.int8) for p in (0.9, 0.8, 0.85))
    wrong = y ^ (rng.random(800) < 0.05)
    votes = np.stack([a, b, c, a, wrong.astype(np.int8)], 1)
    posterior, rates, corr = toxicity.label_model(votes, wrong.astype(float), np.ones(800))
    assert ((posterior > 0.5) == y).mean() > (wrong == y).mean()
    assert corr[0, 3] > 0.99 and abs(corr[0, 1]) < 0.2
    assert rates[1, 0] > 0.8 > 0.05 > rates[0, 0]
