"""The training-data operators against plain versions, and their defined results for odd input."""

import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, components, langid, linear, minhash, mixing, nbsvm, packing, pii, queries, secrets, textkit, topk, urlfilter, vectors

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a very long one, repeated rows, and columns whose names operators use inside."""
    words = [f"w{i % 977}x{i}" for i in range(60000)]
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, "one two"), (6, " ".join(words)), (6, " ".join(words)), (7, "?!"), (8, "?!"), (9, "été à la forêt"), (None, "no id here"), (10, "日本語 テスト")]
    more = [(x, t, None, "src", "text2", 1, 2.0, "k") for x, t in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, id string, rank long, score double, path string").withColumn("bands", F.lit(1)).withColumn("spans", F.lit(1)).withColumn("domain", F.lit("z"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- text hashing ---


def test_words_and_shingles_are_those_of_a_plain_split():
    texts = ["The cat, the CAT sat on a mat", "", "abc", "x1 y2 été z"]
    data, offsets = textkit.utf8(textkit.lower(pa.array(texts)))
    words, at = textkit.word_hashes(data, offsets)
    plain = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()) for t in texts]
    assert list(np.diff(at)) == [len(w) for w in plain]
    names = [w for ws in plain for w in ws]
    assert len({(a, b) for a, b in zip(names, words.tolist())}) == len(set(names)) == len(set(words.tolist()))
    assert [len(s) for s in textkit.shingles(words, at, 5)] == [4, 0, 1, 1]


def test_blocks_cover_all_texts():
    rng = random.Random(3)
    texts = ["a" * rng.randint(0, 400_000) for _ in range(20)]
    data, offsets = textkit.utf8(pa.array(texts))
    seen = [(i, j, len(p)) for i, j, p, _ in textkit.blocks(data, offsets)]
    assert seen[0][0] == 0 and seen[-1][1] == 20 and sum(s[2] for s in seen) == sum(map(len, texts))


# --- op1 ---


def plain_classes(rows, threshold=0.8):
    texts = sorted({t for _, t in rows if t})
    first = {t: min(i for i, x in rows if x == t) for t in texts}
    features = [f for _, fs in minhash.text_features(pa.array(texts)) for f in fs]
    df = np.zeros(minhash.BUCKETS, np.int64)
    for _, fs in minhash.text_features(pa.array([t for _, t in rows])):
        for h, _ in fs:
            df[np.unique(h >> np.uint64(46)).astype(int)] += 1
    idf = minhash.idf_table(df, len(rows))
    sides = [(h, np.exp2(minhash.levels(h, c, idf) / minhash.STEPS)) for h, c in features]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if minhash.similarity(sides[a], sides[b]) >= threshold:
                x, y = root(first[texts[a]]), root(first[texts[b]])
                parent[max(x, y)] = min(x, y)
    return {i: root(first[t] if t else i) for i, t in rows}


def test_minhash_classes_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        for _ in range(6):
            words = list(base)
            for _ in range(int(len(words) * rng.choice((0, 0.005, 0.01, 0.02, 0.1)))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "a b"), (n + 3, "a b"), (n + 4, "?!"), (n + 5, "?!")]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)


def test_far_copies_of_one_text_that_are_near_to_each_other_link(spark):
    """Two copies changed in the same way link, though the least member of their bucket links with neither."""
    rng = random.Random(8)
    base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for family in range(4):
        own = list(base)
        for k in rng.sample(range(200), 12):
            own[k] = f"f{family}k{k}"
        for copy in range(5):
            words = list(own)
            words[rng.randrange(200)] = f"c{family}x{copy}"
            rows.append((len(rows), " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)


def test_samples_collide_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 500, dtype=np.uint64)
    idf = np.ones(minhash.BUCKETS, np.float32)
    a, b = np.sort(hashes[:400]), np.sort(hashes[100:])
    rank, xor, odd = minhash.sampling()

    def samples(h, tf):
        level = minhash.levels(h, tf, idf) * np.uint32(minhash.ROWS)
        point = (h >> np.uint64(16)).astype(np.uint32)
        return np.array([(rank[((point ^ xor[k]) * odd[k] >> np.uint32(17)) + level] | (h & np.uint64(0xFFFFFFFF))).min() for k in range(64)])

    tf_a, tf_b = rng.integers(1, 20, 400), rng.integers(1, 20, 400)
    sides = [(h, np.exp2(minhash.levels(h, t, idf) / minhash.STEPS)) for h, t in ((a, tf_a), (b, tf_b))]
    assert abs((samples(a, tf_a) == samples(b, tf_b)).mean() - minhash.similarity(*sides)) < 0.2


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    stages = common.Stages(spark)
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), stages, "t").collect()}
    assert got == {i: 0 for i in range(21)} | {k: 100 for k in range(100, 140)}


# --- op2 ---


def test_pieces_are_the_tokenizers(spark, docs):
    path = queries.public_vocabulary("word_bpe_49k.json")
    got = packing.pieces(docs, path, with_ids=True).toPandas()
    encoder = packing.ids_of(path).tokenizer
    for r in docs.limit(60).collect():
        ids = [*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        own = got[got.id == r["doc_id"]].sort_values("piece")
        data = b"".join(own.ids)
        assert np.frombuffer(data, "<u4").tolist() == ids
        assert own.start.tolist() == list(range(0, len(ids), 4096))
        assert own.ids_crc32.tolist() == [zlib.crc32(x) for x in own.ids]


def test_ids_of_odd_texts_are_the_tokenizers():
    ids = packing.ids_of(queries.public_vocabulary("word_bpe_49k.json"))
    rng = random.Random(1)
    pool = "aZ éÉ.,'|<>0123_\n\t²ßŁ-\x1c\x85\xa0İΣ日é"
    texts = ["It's I'll <|endoftext|> x", "ΣΑΣ İ", "é", None, ""] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.of(texts)] == [e.ids for e in ids.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_plans_hold_every_piece_once_and_come_near_the_bound():
    rng = np.random.default_rng(4)
    for _ in range(150):
        capacity = int(rng.integers(4, 80))
        histogram = {int(k): int(rng.integers(1, 30)) for k in rng.integers(1, capacity + 1, rng.integers(1, 25))}
        patterns = packing.plan(histogram, capacity)
        total: dict[int, int] = {}
        for pattern, times in patterns:
            assert times > 0 and sum(x * q for x, q in pattern) <= capacity
            for x, q in pattern:
                total[x] = total.get(x, 0) + q * times
        assert total == histogram
        rooms: list[int] = []  # plain best fit, one piece at a time
        for x in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - x)
        assert sum(t for _, t in patterns) <= len(rooms)


def best_number(lengths, capacity):
    """Least number of bins, by trying all."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_reduction_loses_no_optimum():
    rng = random.Random(6)
    for _ in range(120):
        capacity = rng.randint(6, 20)
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        count = np.bincount(lengths, minlength=capacity + 1)
        fixed = packing.reduce(count, capacity)
        rest = sorted((x for x in range(capacity + 1) for _ in range(count[x])), reverse=True)
        assert sum(t for _, t in fixed) + best_number(rest, capacity) == best_number(lengths, capacity)


def check_placed(placed):
    assert not placed.duplicated(["sequence_id", "offset"]).any()
    for _, own in placed.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 4096


def test_packing_is_gapless(spark, docs, odd):
    for df in (docs, odd):
        placed = packing.pack_documents(df, queries.public_vocabulary("word_bpe_49k.json")).toPandas()
        check_placed(placed)
        least = -(-placed.length.sum() // 4096)
        assert placed.sequence_id.nunique() <= 1.1 * least + 2


def test_equal_and_unnamed_rows_are_packed_one_by_one(spark):
    """Many equal rows under one id, null ids, and clashing columns: every row has its place."""
    rows = [(1, "a b c")] * 3000 + [(None, "d")] * 2000 + [(2, None)] * 10
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("length", F.lit(-1)).withColumn("rank", F.lit(0))
    placed = packing.pack_documents(df, queries.public_vocabulary("word_bpe_49k.json")).toPandas()
    check_placed(placed)
    assert ((placed.doc_id == 1).sum(), (placed.doc_id == 2).sum(), placed.doc_id.isna().sum()) == (3000, 10, 2000)
    assert len(placed) == 5010 and placed.sequence_id.nunique() == -(-placed.length.sum() // 4096)


def test_sequences_are_their_pieces(spark, docs):
    cut = packing.numbered(packing.pieces(docs.limit(40), queries.public_vocabulary("word_bpe_49k.json"), with_ids=True), common.Stages(spark))
    placed = packing.pack(cut).cache()
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert bytes(whole[r["sequence_id"]])[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])


# --- op3 ---

RULES = [*queries.URL_RULES, ("a.b", "/x", "block"), ("b", "/xyz", "allow")]
URLS = ["http://A.Org/x", "https://www.example.org/en/12?q=/fr/", "x.com/fr/", "ftp://u.com/fr/#a", "http://com/de/", "http://org", "://", None, "", "http://example.org/es", "http://a.b/xyz", "http://www.a.b/xyz", "http://n.net/?://x", "http://xorg/", "http://.org/", "http://É.org/é"]


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_are_judged_by_the_longest_rule(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    want = {i: plain_rule(u) for i, u in enumerate(URLS)}
    for judge in (urlfilter.judge, urlfilter.judge_by_join):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(pages, rules).collect()}
        assert got == want


def test_odd_urls(spark):
    """Very long hosts and paths, repeated rows, clashing columns, and rules that are null or without a host."""
    long_host, long_path = "." * 200_000, "http://a.b/x" + "/y" * 100_000
    urls = ["http://" + long_host + "a.b/x", long_path, long_path, "://", None]
    pages = spark.createDataFrame([(i // 2, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string")
    rules = spark.createDataFrame([*RULES, *RULES, ("", "", "block"), (None, "/", "block"), ("c", None, "block"), ("d", "/", None)], "host string, path string, verdict string")
    for judge in (urlfilter.judge, urlfilter.judge_by_join):
        got = sorted((r["page_id"], len(r["host"]), len(r["path"]), r["rule"], r["verdict"]) for r in judge(pages, rules).collect())
        assert got == sorted([(0, 200_003, 2, "a.b/x", "block"), (0, 3, len(long_path) - 10, "a.b/x", "block"), (1, 3, len(long_path) - 10, "a.b/x", "block"), (1, 0, 0, "", "block"), (2, 0, 0, "", "block")])


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda s, seed: len(s) % 3)
    urlfilter.Digests.write([(f"h{i}", "/", "block") for i in range(50)], str(tmp_path / "r"))
    found = urlfilter.Digests(str(tmp_path / "r"))
    asked = [f"h{i}\n/".encode() for i in range(60)]
    at = found.find(asked)
    assert (at[:50] >= 0).all() and (at[50:] < 0).all()
    assert all(found.text(int(k)) == s for k, s in zip(at[:50], asked))


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [r["verdict"] for r in urlfilter.judge(pages, rules).collect()] == ["allow"]
    assert urlfilter.judge(pages.limit(0), rules).count() == 0


# --- op4, op10 ---


def naive_pii(text):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def naive_secrets(text):
    out = [(m.start(), "assign", m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(9)
    for _ in range(6000):
        t = "".join(rng.choice("a1.2-@ +()c3%_45") for _ in range(rng.randint(0, 60)))
        assert sorted(pii.base_spans(t)) == naive_pii(t)
        parts = ("passWord", "api_key", "APIKEY", "token", "secret", "=", ": ", '"', "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", " ", "x", "é", "passwd")
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert sorted(secrets.base_spans(t)) == naive_secrets(t)


def test_scans_find_what_plain_patterns_find(spark, docs):
    vocabulary = queries.public_vocabulary("byte_bpe_50k.tiktoken")
    for scan, naive, kinds in ((pii.scan(docs), naive_pii, pii.KINDS), (secrets.scan(docs, vocabulary), naive_secrets, secrets.KINDS[:3])):
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        for r in scan.collect():
            base = sorted((s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] in kinds)
            assert base == naive(texts[r["id"]])


def test_boosted_trees_tell_addresses_from_numbers():
    model, bounds = pii.trained()
    kinds = lambda t: {k for _, k, _ in pii.text_spans(t, model, bounds)}
    assert "more_phone" in kinds("call (555) 123-4567 now")
    assert "more_email" in kinds("write bob.x (at) foo dot com please")
    assert kinds("between 1999-2001 it was 12.05.2003, version 1.2, page 100 200 300") == set()
    held = pii.generated(600, seed=99)
    hit = [any(a < e and b > s for a, k, b in pii.text_spans(t, model, bounds)) for t, s, e, _ in held]
    labels = np.array([x[3] for x in held], bool)
    assert np.mean(np.array(hit)[labels]) > 0.7 and np.mean(np.array(hit)[~labels]) < 0.1


def test_random_strings_are_told_from_words_and_known_digests():
    v = queries.public_vocabulary("byte_bpe_50k.tiktoken")
    random_string = "x9Kq2LmZ8vTr4WbY7cNp1JdG"
    assert [k for _, k, _ in secrets.text_spans(f"use {random_string} now", v, 2.0)] == ["random"]
    for plain in ("internationalization_of_words", "123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "2024-01-02-2024-01-03", "ThisIsAnIdentifierName"):
        assert secrets.text_spans(f"see {plain} here", v, 2.0) == []


def test_redaction_replaces_unions_of_spans():
    assert secrets.replace_spans("abcdefghij", [(1, "x", 3), (2, "y", 5), (7, "z", 8)], "#") == "a#fg#ij"


def test_no_generator_fits_what_the_prefilter_leaves_out(spark):
    lines = [f"write to anna{at}web{dot}de today" for at in (" at ", " AT ", " (at) ", "[At]", " {aT} ", "(a)", " (A) ") for dot in (".", " . ", " dot ", " [dot] ", "(DOT)", " (punkt) ", " (Punkt) ")]
    lines += ["host dead:beef:cafe:fade answers", "host a:b:c:d:e:f:a:b answers"]
    assert all(pii.candidates(t) for t in lines)
    lines += ["we met at noon", "nothing here.", "a dot at the end"]
    model, bounds = pii.trained()
    want = {i: pii.text_spans(t, model, bounds) for i, t in enumerate(lines)}
    got = {r["id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    fits = pa.compute.match_substring_regex(pa.array(lines), pii._MAY_HAVE).to_pylist()
    assert all(fit for t, fit in zip(lines, fits, strict=True) if pii.candidates(t))
    assert got == want


def test_scan_is_the_spans_of_each_text_on_random_texts(spark):
    """The prefilter hides nothing, whatever else a text holds."""
    rng = random.Random(21)
    parts = ("anna", "web", "de", " at ", " (at) ", "[AT]", "(a)", "{at}", "@", ".", " dot ", "[dot]", "(punkt)", " (Punkt) ", ":", "dead", "beef", "a", "1", "+49", "(555) ", "123-4567", "4111", " ", "-", "/", "DE12", "iban ", "call ", "mail ", "\n", "é", "und")
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    model, bounds = pii.trained()
    got = {r["id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: pii.text_spans(t, model, bounds) for i, t in enumerate(texts)}


def test_accepted_spans_never_overlap_and_the_likeliest_stays():
    model, bounds = pii.trained()
    rng = random.Random(5)
    for _ in range(200):
        text = " ".join(rng.choice(("call (555) 123-4567", "tel 030/123456", "4111/1111/1111/1111", "iban DE12 1234 5678 1234 5678 12", "b.x (at) foo dot com", "and", "12")) for _ in range(20))
        added = [s for s in pii.text_spans(text, model, bounds) if s[1] in pii.ADDED]
        assert all(x[2] <= y[0] for x, y in zip(added, added[1:]))


def test_many_spans_in_one_text():
    import time

    text = "call (555) 123-4567 now, " * 50_000
    begun = time.process_time()
    found = pii.text_spans(text, *pii.trained())
    assert len(found) == 50_000 and time.process_time() - begun < 30


# --- op5 ---


def test_vectors_are_linked_as_by_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = []
    for label in (0, 1, None):
        for _ in range(60):
            base = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 5))):
                rows.append((base + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.3])).astype(np.float32).tolist() + [label])
    table = [(i, r[:-1], r[-1]) for i, r in enumerate(rows)]
    table += [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] + [1.0] * 15, 0), (9003, table[0][1], 0), (9004, [], 1), (9005, [1.0, 2.0], 0)]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(table)
    parent = {t[0]: t[0] for t in table}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = dict.fromkeys(parent, 0)
    for a in table:
        for b in table:
            if a[0] < b[0] and a[2] is not None and a[2] == b[2] and a[1] and b[1] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = root(a[0]), root(b[0])
                    parent[max(p, q)] = min(p, q)
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == {i: root(i) for i in parent}


def test_split_labels_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 64)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 32))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05]).astype(np.float32)
    got = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.93).sum() - len(x)
    assert 0.9 * true <= got.n_links.sum() <= true


def brute(x):
    """The number of links of each vector, and the least position in its component."""
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= vectors.COSINE
    least = np.arange(len(x))
    while ((now := np.where(linked, least[None, :], len(x)).min(axis=1)) != least).any():
        least = now
    return linked.sum(axis=1) - 1, least


@pytest.mark.parametrize("tile", [1 << 21, 4 * 64 * 16])
def test_pairs_without_a_common_shard_are_linked(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "SHARD", 64)
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(600, 16))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.33]).astype(np.float32)
    got = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).toPandas().sort_values("vec_id")
    n_links, least = brute(x)
    assert got.n_links.tolist() == n_links.tolist()
    assert got.component_id.tolist() == least.tolist()


def test_a_dense_group_larger_than_a_shard_has_all_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 64)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=32) + rng.normal(size=(400, 32)) * 0.12).astype(np.float32)
    x = np.concatenate([x, x[:5]])
    n_links, least = brute(x)
    assert n_links.min() == len(x) - 1
    got = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == n_links.tolist()
    assert (got.component_id == 0).all() and got.kept.sum() == 1


def test_double_vectors_are_compared_in_double_precision(spark):
    near = [1.0, 0.0, 1e-9]
    at_bound = [0.93, (1 - 0.93**2) ** 0.5 - 1e-12, 0.0]
    beyond = [0.93, (1 - 0.93**2) ** 0.5 + 1e-9, 0.0]
    table = [(1, [1e300, 0.0, 0.0], 0), (2, [-1e-300, 0.0, 0.0], 0), (3, [x * 1e200 for x in at_bound], 0), (4, beyond, 0), (5, near, 1), (5, [0.0, 1.0, 0.0], 1), (5, near, 1), (None, near, 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("x")).withColumn("path", F.lit(1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (2, 0, 2, True), (3, 2, 1, False), (4, 1, 1, False), (5, 0, 5, True), (5, 1, 5, True), (5, 1, 5, True)]


def test_odd_vectors(spark):
    """Null labels, lengths that differ, whole numbers, and a hot vector that a third of the rows share."""
    table = [(i, [1, 2, 3], 0) for i in range(40)] + [(100 + i, [i, 1 - i, 7], 0) for i in range(40)] + [(200 + i, [1, 2, 3], None) for i in range(3)] + [(300, [1, 2], 0)]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<int>, label int")).collect()}
    x = np.array([v for _, v, label in table[:80]], float)
    n_links, least = brute(x)
    assert [got[i]["n_links"] for i, _, _ in table[:80]] == n_links.tolist()
    assert [got[i]["component_id"] for i, _, _ in table[:80]] == [table[k][0] for k in least]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (200, 201, 202, 300))


# --- op6, op9 ---


def test_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] - x[:, 1] > 0, 1.0, -1.0)
    rows = linear.Rows.of([(np.arange(5), v) for v in x])
    w, b = linear.svm(rows, y, 5, cost=10, epochs=100)
    assert ((rows.dot(w) + b > 0) == (y > 0)).mean() > 0.98


def test_coordinate_descent_reaches_the_dual_optimum():
    """The primal and the dual objective, said plainly, agree at the end; the optimum of all others is no better."""
    rng = np.random.default_rng(1)
    x, cost = rng.normal(size=(80, 6)), 0.7
    y = np.where(x[:, 0] + 0.8 * rng.normal(size=80) > 0, 1.0, -1.0)
    w, b = linear.svm(linear.Rows.of([(np.arange(6), v) for v in x]), y, 6, cost=cost, epochs=500)

    def primal(u):
        return u @ u / 2 + cost * (np.maximum(0, 1 - y * (x @ u[:-1] + u[-1])) ** 2).sum()

    best = np.append(w, b)
    loss = np.maximum(0, 1 - y * (x @ w + b))
    alpha = 2 * cost * loss  # where the slope of the dual is 0 or alpha is
    assert np.allclose((alpha * y) @ np.column_stack([x, np.ones(80)]), best, atol=1e-2)
    dual = alpha.sum() - best @ best / 2 - (alpha**2).sum() / (4 * cost)
    assert abs(primal(best) - dual) < 1e-2 * primal(best)
    assert all(primal(best + rng.normal(size=7) * s) >= primal(best) - 1e-6 for s in (0.001, 0.01, 0.1) for _ in range(50))


def test_quality_model_is_the_plain_one():
    """Log-count ratios by counting, scaled indicators of length one, and a score from a plain sum."""
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, 60)
    rows = [np.unique(rng.integers(0, 40, 12) + 15 * y) for y in labels]
    model = nbsvm.fit(rows, labels)
    used = [i for i in range(60) if i % 5 != 4]
    count = [{}, {}]
    for i in used:
        for k in rows[i]:
            count[labels[i]][k] = count[labels[i]].get(k, 0) + 1
    whole = [sum(c.values()) + nbsvm.DIMS for c in count]
    ratio = np.zeros(nbsvm.DIMS)
    for k in range(60):
        a, b = count[1].get(k, 0), count[0].get(k, 0)
        if a + b > 1:
            ratio[k] = np.log((a + 1) / whole[1]) - np.log((b + 1) / whole[0])
    data = linear.Rows.of([(rows[i], ratio[rows[i]] / len(rows[i]) ** 0.5) for i in used])
    w, bias = linear.svm(data, 2.0 * labels[used] - 1, nbsvm.DIMS)
    assert np.allclose(model.weights, w * ratio) and model.bias == pytest.approx(bias)
    margin = [sum(model.weights[k] for k in r) / len(r) ** 0.5 + bias for r in rows]
    want = 1 / (1 + np.exp(-(model.slope * np.array(margin) + model.shift)))
    at = np.cumsum([0, *map(len, rows)])
    assert np.allclose(model.scores(at, np.concatenate(rows)), want)


def test_labelled_rows_of_one_id_count_once(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    some = docs.limit(60).select("doc_id", "text", "lang")
    twice = some.unionByName(some).unionByName(some)
    one, three = nbsvm.train(some, labels), nbsvm.train(twice, labels)
    assert np.array_equal(one.weights, three.weights) and (one.slope, one.shift) == (three.slope, three.shift)
    one, three = langid.train(some, sample=1000), langid.train(twice, sample=1000)
    assert one.families == three.families and all(np.array_equal(a, b) for (a, _), (b, _) in zip(one.outer, three.outer))


def test_quality_held_out(spark):
    # On the larger table: enough labels to learn from.
    got = queries.op6_quality_nbsvm(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert held[held.quality == 1].predicted.mean() > 0.99
    assert ((got.held_out) == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()


def test_quality_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = nbsvm.train(odd, labels)
    assert {round(r["score"], 3) for r in nbsvm.score(odd, model).collect()} == {0.5}


def test_language_held_out(spark):
    got = queries.op9_language_hierarchy(spark, "/root/testdata/sf0.1").toPandas()
    true = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(true, on="doc_id")
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_is_that_of_the_plain_votes(spark):
    """The hierarchy, said plainly on one text at a time; ties and repeated texts; the bound on bytes."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("de hond en de kat", "nl"), ("le chat et le chien", "fr"), ("el gato y el perro", "es"), ("ignored", None)] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("least", F.lit(1)).withColumn("bytes", F.lit("x"))
    model = langid.train(df)
    assert model.families == ["germanic", "romance"] and model.members == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"]}
    texts = [r[1] for r in rows[:6]] + ["zzz", "the le de el", "der hund und die katze"]
    langs, scores = model.predict(pa.array(texts))
    for text, lang in zip(texts, langs):
        (where, share), = langid.features(pa.array([text]))
        margin = [w[where] @ share + b for w, b in model.outer]
        own = model.members[model.families[int(np.argmax(margin))]]
        votes = dict.fromkeys(own, 0.0)
        for (x, y), (w, b) in model.inner.items():
            if x in own:
                m = float(w[where] @ share + b)
                votes[x] += (m >= 0) + 1e-6 * m
                votes[y] += (m < 0) - 1e-6 * m
        assert lang == max(own, key=votes.get)
    assert langs[1] == langs[8] and scores[1] == scores[8] and langs[:5] == [r[2] for r in rows[:5]]
    none = langid.Model(["a", "b"], {"a": ["x", "y"], "b": ["z"]}, [(np.zeros(langid.DIMS, np.float32), 0.0)] * 2, {("x", "y"): (np.zeros(langid.DIMS, np.float32), 0.0)})
    assert none.predict(pa.array(["any", "text"]))[0] == ["x", "x"]


def test_features_that_the_driver_fetches_are_bounded(spark, docs, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda rows, langs: seen.update(bytes=sum(4 * len(i) + 8 * len(v) for i, v in rows), langs=set(langs)) or langid.Model())
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 400_000)
    langid.train(docs)
    assert 0 < seen["bytes"] <= 400_000 and len(seen["langs"]) > 1


def test_language_of_texts_without_letters(spark, docs, odd):
    model = langid.train(docs)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).collect()]
    assert {i for i, x in got if x == "und"} == {1, 2, 3, 7, 8}
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(docs.limit(0))).collect()} == {"und"}


def test_scores_do_not_depend_on_the_block(docs, spark):
    model = langid.train(docs)
    texts = pa.array([r["text"] for r in docs.limit(30).collect()])
    whole = model.predict(texts)
    alone = [model.predict(texts.slice(i, 1)) for i in range(30)]
    assert whole[0] == [a[0][0] for a in alone]
    assert np.allclose(whole[1], [a[1][0] for a in alone])


# --- op7 ---


def plain_rates(tokens, p, targets, steps=20000, ridge=mixing.RIDGE):
    """The same least squares, by many small steps on documents."""
    x, total = np.ones(len(tokens)), tokens.sum()
    share = (tokens @ p) / total
    for _ in range(steps):
        error = (tokens * x) @ p / total - targets
        x = np.maximum(0, x - 0.2 * (p @ (error / np.maximum(share, 1e-12)) + ridge * (x - 1)))
    return x


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet((0.3, 0.3, 0.3), 200)
    tokens = rng.integers(1, 500, 200).astype(float)
    cells = spark.createDataFrame([(float(t), *map(float, q)) for t, q in zip(tokens, p)], "tokens double, p0 double, p1 double, p2 double")
    for targets, steps in (([0.5, 0.3, 0.2], 5), ([0.6, 0.3, 0.1], 60), ([0.0, 0.5, 0.5], 20)):
        got = cells.withColumn("rate", mixing.fit_rates(cells, 3, targets, steps=steps)).toPandas()
        sums = [(got.rate * got.tokens * got[f"p{k}"]).sum() / tokens.sum() for k in range(3)]
        assert (got.rate >= 0).all()
        assert np.allclose(sums, targets, atol=0.01 if steps != 20 else 0.05)
        x, total = np.ones(len(tokens)), tokens.sum()
        share = (tokens @ p) / total
        same = []
        for _ in range(60):  # the steps of documents, said plainly
            error = (tokens * x) @ p / total - targets
            x = np.maximum(0, x - (p @ (error / share) + mixing.RIDGE * (x - 1)) / (1 + mixing.RIDGE))
            same.append(np.allclose(got.rate, x, atol=1e-6))
        assert any(same)
    want = plain_rates(tokens, p, np.array([0.5, 0.3, 0.2]))
    got = cells.withColumn("rate", mixing.fit_rates(cells, 3, [0.5, 0.3, 0.2])).toPandas()
    assert np.allclose(got.rate, want, atol=0.1)


def test_posteriors_of_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = queries.domain_labels(spark.read.parquet("/root/testdata/sf0.1/labels.parquet")).where("domain is not null")
    rest = labels.where(common.fold("doc_id") != 0)
    domains = ["clean", "low", "toxic"]
    prior, weights = mixing.classifier(docs, rest, domains, common.Stages(spark), id_col="doc_id", text_col="text", sample=mixing.SAMPLE, n_terms=mixing.TERMS)
    held = labels.where(common.fold("doc_id") == 0)
    p = mixing.posteriors(docs.join(held.select("doc_id"), "doc_id", "left_semi"), prior, weights, id_col="doc_id", text_col="text", keep=[]).withColumnRenamed("id", "doc_id").join(held, "doc_id").toPandas()
    of = p[["p0", "p1", "p2"]].to_numpy()
    assert np.allclose(of.sum(axis=1), 1)
    right = np.array(domains)[of.argmax(axis=1)] == p.domain
    assert right.mean() > 0.85
    for k, d in enumerate(domains):  # what a domain is thought to hold is near to what it holds
        assert abs(of[:, k].mean() - (p.domain == d).mean()) < 0.15


def test_mix_of_the_documents(spark):
    got = queries.op7_soft_membership_mixing(spark, "/root/testdata/sf0.01").toPandas()
    n = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert len(got) == n and (got.copies >= np.floor(got.rate)).all() and (got.copies <= np.ceil(got.rate)).all()
    total = got.tokens.sum()
    for domain, share in queries.MIX_TARGETS.items():
        assert abs((got.rate * got.tokens * got[f"p_{domain}"]).sum() / total - share) < 0.02
    assert np.allclose(got[["p_clean", "p_low", "p_toxic"]].sum(axis=1), 1)


# --- op8 ---


def test_top_k_is_exact_with_ties_and_copies(spark):
    rng = np.random.default_rng(7)
    codes = rng.integers(-(2**63), 2**63 - 1, 300)
    codes[50:120] = codes[0]  # a hot code
    codes[120:150] = codes[1] ^ 1
    rows = [(int(i), int(c)) for i, c in enumerate(codes)] + [(1000, None), (None, 5)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = topk.top_k(df, df.where("id % 7 = 0 or id = 1000"), 10).toPandas()
    u = codes.view(np.uint64)
    for q in range(0, 300, 7):
        far = np.bitwise_count(u ^ u[q]).astype(int)
        want = sorted((d, i) for i, d in enumerate(far) if i != q)[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert list(zip(own.distance, own.neighbor_id)) == want
    assert set(got.query_id) == set(range(0, 300, 7))


def test_few_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, 7)], "id long, code long")
    assert [(r["query_id"], r["neighbor_id"], r["distance"]) for r in topk.top_k(df, df.where("id = 1"), 10).collect()] == [(1, 2, 1)]
    assert topk.top_k(df.limit(0), df.limit(0), 3).count() == 0


def test_sign_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0, 2.0] + [0.0] * 60 + [3.0],), (None,), ([float("nan")] * 64,), ([1.0] * 66,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(topk.sign_code(F.col("v"))).collect()] == [[5 - 2**63], None, None, [-1, 3], None]


def test_top_k_of_wide_codes_is_exact(spark):
    """Codes of three words near to one another, others of one word, repeated ids and clashing columns."""
    rng = np.random.default_rng(11)
    base = rng.integers(-(2**63), 2**63 - 1, (6, 3))
    codes = [base[i % 6] ^ np.array([1 << int(b) if b < 63 else 0 for b in rng.integers(0, 80, 3)]) for i in range(240)]
    rows = [(i, [int(w) for w in c]) for i, c in enumerate(codes)] + [(500 + i, [int(i)]) for i in range(20)] + [(7, [2**62, 0, 0]), (900, [1, None]), (901, [])]
    df = spark.createDataFrame(rows, "id long, code array<long>").withColumn("segment", F.lit("x")).withColumn("first", F.lit(1)).withColumn("n", F.lit(0))
    got = topk.top_k(df, df.where("id % 9 = 0 or id = 7"), 5).toPandas()
    once = {}
    for i, c in rows:
        if c and None not in c:
            once[i] = min(once.get(i, c), c)
    for q in [i for i in once if i % 9 == 0 or i == 7]:
        want = sorted((sum((a ^ b).bit_count() if (a ^ b) >= 0 else ((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(once[q], c)), i) for i, c in once.items() if i != q and len(c) == len(once[q]))[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert list(zip(own.distance, own.neighbor_id)) == want and own["rank"].tolist() == list(range(1, len(want) + 1))
    assert set(got.query_id) == {i for i in once if i % 9 == 0 or i == 7}


# --- oracles, odd and empty tables ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    key = list(want.columns)
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True).astype(object), want.sort_values(key).reset_index(drop=True).astype(object), check_dtype=False)


def test_odd_documents(spark, odd):
    vocabulary = queries.public_vocabulary("byte_bpe_50k.tiktoken")
    n = 12
    assert pii.scan(odd).count() == n and secrets.scan(odd, vocabulary).count() == n
    redacted = secrets.scan(odd, vocabulary, redact="#", keep=["lang", "rank"])
    assert redacted.count() == n and {r["id"] for r in redacted.where("text is null").collect()} == {1}
    classes = {(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(odd).collect()}
    assert classes == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (9, 9), (10, 10)}
    labels = spark.createDataFrame([(4, "a"), (9, "b"), (4, "b"), (None, "a")], "doc_id long, domain string")
    mixed = mixing.mix(odd, labels, {"a": 0.5, "b": 0.5}, keep=["rank", "text"])
    assert mixed.count() == n - 1 and mixed.where("tokens = 0").count() == 5  # null, empty, blank, and two of marks alone
    labels = spark.createDataFrame([(4, 1), (9, 0), (6, 1), (None, 0)], "doc_id long, quality int")
    scored = nbsvm.score(odd, nbsvm.train(odd, labels), keep=["rank"]).toPandas()
    assert len(scored) == n and scored.score.between(0, 1).all()
    of = {i: set(own.score) for i, own in scored.groupby("doc_id")}
    assert of[1] == of[2] == of[3] and of[4] == of[5] and of[7] == of[8] and len(of[6]) == 1  # no indicators; equal texts; repeated rows


def test_spans_of_odd_documents(spark, odd):
    """Spans of null, empty, very long and repeated texts, and of texts full of them, are those of each text by itself."""
    vocabulary = queries.public_vocabulary("byte_bpe_50k.tiktoken")
    full = "mail a.b@c.de or 10.0.0.1, +49 170 1234567; password: hunter22x " * 2000
    more = spark.createDataFrame([(20, full), (20, full), (21, "x" * 300_000), (22, "AKIA" + "A" * 40)], "doc_id long, text string")
    table = odd.select("doc_id", "text").unionByName(more)
    for found, base in ((pii.scan(table), pii.base_spans), (secrets.scan(table, vocabulary), secrets.base_spans)):
        kinds = pii.KINDS if base is pii.base_spans else secrets.KINDS[:3]
        got = sorted((r["id"] if r["id"] is not None else -1, [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] in kinds]) for r in found.collect())
        want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, sorted(map(tuple, base(r["text"] or "")), key=lambda s: (s[0], kinds.index(s[1])))) for r in table.collect())
        assert got == want
        assert all(not spans for i, spans in got if i in (1, 2, 3, 7)) and sum(len(s) for i, s in got if i == 20) >= 2 * 2000


def test_empty_tables(spark, none, tmp_path):
    vocabulary = queries.public_vocabulary("byte_bpe_50k.tiktoken")
    assert minhash.near_duplicates(none).count() == 0
    assert packing.pack_documents(none, queries.public_vocabulary("word_bpe_49k.json")).count() == 0
    assert pii.scan(none).count() == 0 and secrets.scan(none, vocabulary, redact="#").count() == 0
    labels = spark.createDataFrame([], "doc_id long, domain string")
    assert mixing.mix(none, labels, {"a": 1.0, "b": 1.0}).count() == 0
    assert langid.predict(none, langid.train(none)).count() == 0
    assert nbsvm.score(none, nbsvm.train(none, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
