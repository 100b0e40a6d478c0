"""The corpus operators against brute force on small tables, with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parallaxis.llm import ann, licenses, lyndon, mixing, near_vectors, ngram_join, packing, pii, substrings, toxicity, urls

WORDS = "the of and in to red blue green stone river cloud ice storm light dark north wind".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, k1 string, h string, key string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "er"]) for _ in range(n))


def corpus(seed=0):
    """Texts with copies, near copies, a shared passage, empty and null ones, one long, repeated lines."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    texts += [texts[3], texts[3], texts[4] + " tail", "Head " + texts[5], None, "", "  \n", "x", "One two", "one TWO"]
    texts += [f"{prose(rng, 10)} {passage} {prose(rng, 5)}" for _ in range(6)]
    base = prose(rng, 150).split()
    for _ in range(40):  # a crowd of near copies
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(50))
        texts.append(" ".join(copy))
    texts += ["ab" * 400, "ab" * 300, prose(rng, 4000), "é" * 90 + " ö Ünder É"]
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), "clash", "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing_is_a_partition_of_the_ids(docs, nothing):
    from tokenizers import Tokenizer

    t, window = Tokenizer.from_file(tokenizer()), 256
    rows = packing.pack_documents(docs, tokenizer(), window=window, with_ids=True).collect()
    ids = {d[0]: np.array(t.encode(d[1] or "", add_special_tokens=False).ids + [2], dtype="<u4") for d in corpus()}
    at, sequences = Counter(), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.ids == part.tolist() and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(at[k] == len(v) for k, v in ids.items())
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= window and end & (end - 1) == 0  # full, or a power of two
    assert packing.pack_documents(nothing, tokenizer()).count() == 0


def test_tokens_equal_the_library_on_odd_words():
    tokens = packing.Tokens(tokenizer())
    odd = ["Straße<|endoftext|>x", "ΑΣ", "don't.", "it's'll,", "a\tb", "x y", "ſ", "日本語.", "naïve²½", "\x00a", "...", " a  b\n\nc ", "ﬁ", "İx", "É.", "a.b.,", "", ".", "5.", "<|ENDOFTEXT|>"]
    for word in [*odd, " ".join(odd)]:
        assert tokens.text(word).tolist() == tokens.library.encode(word, add_special_tokens=False).ids


def test_every_word_end_token_is_reachable():
    tokens = packing.Tokens(tokenizer())
    model = tokens.library.model
    for word, i in tokens.library.get_vocab().items():
        if word.endswith("</w>") and len(word) > 4:
            assert [x.id for x in model.tokenize(word[:-4])] == [i]


def components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize(("n", "threshold"), [(3, (9, 10)), (5, (4, 5))])
def test_jaccard_components_equal_all_pairs(docs, nothing, n, threshold):
    a, b = threshold
    sets = []
    for d in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", (d[1] or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    links = lambda i, j: bool(sets[i] and sets[j]) and b * len(sets[i] & sets[j]) >= a * len(sets[i] | sets[j])
    expected = components(len(sets), links)
    got = {r.doc_id: r for r in ngram_join.jaccard_components(docs, n, threshold).collect()}
    assert [got[i].component_id for i in range(len(sets))] == expected and [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    kept = ngram_join.keep_one(docs, n, threshold)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(sets)) if expected[i] == i]
    assert ngram_join.jaccard_components(nothing, n, threshold).count() == 0


def test_suffix_arrays():
    rng = random.Random(1)
    for k in range(400):
        s = [rng.randrange(rng.choice([1, 2, 3, 25])) for _ in range(rng.randint(0, 40))]
        s = (s[:3] * 15)[: len(s)] if k % 3 == 0 else s
        assert lyndon.suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_substrings_equal_brute_force(docs, nothing):
    seen, expected = set(), {}
    for doc_id, text, *_ in corpus():
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        expected[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect()}
    assert got == expected
    assert substrings.dedup_substrings(nothing).count() == 0


def test_license_phrases_and_notices(spark, nothing):
    mit = licenses.NOTICES[2][1].split()
    texts = ["Apache License apache license", "GNU General Public License; cc BY", "cc bye", None, "", "x " * 500 + " ".join(mit[:12] + ["oops"] + mit[12:]) + " y", "mit\tlicense mit"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [(2, 0, 2, "apache"), (2, 0, 4, "cc-by,gpl"), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (1, 0, 0, "mit")]
    assert got[5].labels == "mit" and 0.6 <= got[5].score <= 1 and got[2].labels == "" and got[3].n_words == 0
    assert licenses.scan_licenses(nothing).count() == 0


def test_urls(spark):
    rows = ["http://WWW.Example.com/en/x", "https://a.example.com/en/1?q", "http://example.com/fr/", "x.net/es/", None, "http://b.net/es/#t", "ftp://net/fr/", "http://xnet/fr/", "http://m.spam-farm.example.org/de/", "http://com", "://", "http://a.com/" + "y" * 100_000]
    got = urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [
        ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), (None, "block"), (None, "block"), ("net/es/", "block"), ("net/fr/", "block"),
        (None, "allow"), (None, "block"), (None, "allow"), (None, "block"), ("com/", "allow"),
    ]
    assert got[0].host == "www.example.com" and got[0].path == "/en/x" and got[9].path == ""


def test_mixing_meets_targets(docs, nothing):
    rows = mixing.mix_sources(docs).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(5)).collect()}
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert own[0].source_size == sum(r.size for r in own) and own[0].target <= 2 * own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(1, max(r.size for r in own) / 2)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    total = sum(r.size for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * total) < 1e-6
    taken = Counter(r.doc_id for r in mixing.take_copies(docs).collect())
    assert all(taken[r.doc_id] == (r.taken // r.size if r.size else 1) for r in rows)
    assert mixing.mix_sources(nothing).count() == 0


def test_toxicity_learns_and_covers_odd_texts(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 80).replace(" storm ", " vilething grotslur ", 3) if i % 4 == 0 else prose(rng, 80), int(i % 4 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2 and ("vilething" in r[1]) == bool(r[2])]
    right = sum(got[r[0]].predicted == r[2] for r in held) / len(held)
    assert right > 0.9 and 0 <= got[5000].score <= 1 and got[5000].score == got[5001].score


def test_pii_base_spans_and_redaction(spark, nothing):
    text = "Mail a.b@c.de or x@y, 10.0.0.256 10.0.0.1, 4111 1111 1111 1111 call +1 (555) 010-9999 now a@b.c.@d.e"
    at = lambda kind, part, n: (kind, text.index(part), text.index(part) + n)
    assert pii.base_spans(text) == [
        at("email", "a.b@c.de", 8), at("ip", "10.0.0.1,", 8), at("card", "4111", 19), at("phone", "+1", 17), at("email", "a@b.c.", 5), at("email", ".@d.e", 5),
    ]
    docs = spark.createDataFrame([(1, "write to a.b@c.de now", 21), (2, None, None), (3, "", 0), (4, "1" * 50_000, 50_000)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.redact_pii(docs).collect()}
    assert got[1].text == "write to <EMAIL> now" and got[1].n_chars == len(got[1].text) and got[2].text is None and got[4].text == "1" * 50_000
    assert pii.find_pii(nothing).count() == 0


def vectors(spark, n=600, dim=16):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    x[100:140] = x[100] + rng.normal(0, 0.05, (40, dim))
    x[200:220] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[50], rows[51], rows[52], rows[53] = (50, None), (51, [0.0] * dim), (52, [float("nan")] * dim), (53, [1.0, None] + [0.0] * (dim - 2))
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def valid(v):
    return v is not None and None not in v and np.isfinite(v).all() and any(v)


def test_near_vectors_equal_all_pairs(spark):
    rows, frame = vectors(spark)
    u = [np.array(v) / np.linalg.norm(v) if valid(v) else None for _, v in rows]
    links = lambda i, j: u[i] is not None and u[j] is not None and float(u[i] @ u[j]) >= 0.9
    expected = components(len(rows), links)
    got = {r.vec_id: r for r in near_vectors.near_duplicates(frame).collect()}
    assert [got[i].component_id for i in range(len(rows))] == expected
    assert [got[i].n_links for i in range(len(rows))] == [sum(links(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    assert near_vectors.near_duplicates(frame.limit(0)).count() == 0


def test_nearest_neighbours(spark):
    rows, frame = vectors(spark)
    ok = {i: np.array(v) for i, v in rows if valid(v)}
    got = {}
    for r in ann.nearest_neighbours(frame, frame.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    for q, best in got.items():
        assert sorted(best) == list(range(1, 11)) and all(abs(np.linalg.norm(ok[q] - ok[i]) - s) < 1e-12 for i, s in best.values())
        true = sorted((float(np.linalg.norm(ok[q] - v)), i) for i, v in ok.items() if i != q)[:10]
        hit += len({i for _, i in true} & {i for i, _ in best.values()})
    assert set(got) == {i for i in ok if i % 20 == 0} and hit >= 0.9 * 10 * len(got)
    few = frame.where("vec_id < 4")
    assert ann.nearest_neighbours(few, few, 10).count() == 12
    assert ann.nearest_neighbours(frame.limit(0), frame, 10).count() == 0
