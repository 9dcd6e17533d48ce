"""Operators against brute force, round trips and held-out accuracy, with the odd cases each docstring names."""

import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from relata.llm import common, components, conversations, decontam, golay, langid, licenses, linededup, media, packing, quality, simhash, warc, webp
from relata.llm.queries import ORACLES, QUERIES

TABLES = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not TABLES.exists(), reason="no generated tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **extra):
    df = spark.createDataFrame([(k, t, "en", "s", None) for k, t in enumerate(texts)], DOCS)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " ", "\n\n", "a", "a b", "ünïcödé wörds — 日本語 text", "x" * 70_000, "word " * 9_000, "a\tb\x0bc\x0cd", "tail space ", " lead"]


# ------------------------------------------------------------ all of them


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_forms(spark, name):
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, str(TABLES))
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert found == sorted(map(repr, con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()))


@pytest.mark.parametrize("texts", [[], ODD, ODD + ODD])
def test_empty_odd_and_repeated_rows(spark, texts):
    df = docs(spark, texts, score=1.0, lang_pred="x", h1=1, bytes="b", fp=3, label="l", rank=1)
    model = langid.fit(df)
    n = len(texts)
    assert langid.predict(df, model).count() == n
    assert quality.predict(df, np.zeros((1 << quality.HASH_BITS) + 1, np.float32)).count() == n
    assert simhash.near_duplicates(df).count() == n
    assert licenses.scan_licenses(df).count() == n
    assert media.media_columns(df).count() == n
    cleaned = linededup.dedup_lines(df)
    assert cleaned.count() == n and cleaned.columns[: len(df.columns)] == df.columns
    assert packing.pack(df).select("doc_id").distinct().count() == n
    bench = spark.createDataFrame([(1, "never seen words here at all"), (2, None), (3, "")], "item_id long, text string")
    assert decontam.find_leaks(df, bench).count() == 0
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(df, bench).columns == df.columns


# ------------------------------------------------------------ language ID


@pytest.fixture(scope="module")
def two_languages(spark):
    rng = random.Random(3)
    parts = {"aa": ["ther", "tion", "and", "ing"], "bb": ["schö", "ung", "ein", "der"]}
    rows = [(k, " ".join("".join(rng.choices(parts[x], k=2)) for _ in range(30)), x) for k in range(80) for x in [("aa", "bb")[k % 2]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_accuracy(two_languages):
    model = langid.fit(two_languages.filter("doc_id < 60"))
    found = langid.predict(two_languages.filter("doc_id >= 60"), model).collect()
    assert all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in found)


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁", "a", "b", "ab", "▁ab"]
    s = langid.Segmenter({x: k for k, x in enumerate(pieces)})
    p = np.array([0.1, 0.2, 0.3, 0.05, 0.15, 0.2, 0.0, 1e-9])[:, None]

    def brute(word):
        if not word:
            return 1.0
        return sum(p[s.index[word[:m]], 0] * brute(word[m:]) for m in range(1, len(word) + 1) if word[:m] in s.index)

    for w in ("ab", "aab", "abab", "bbba"):
        assert np.exp(langid.log_likelihoods([w], s, p)[0, 0]) == pytest.approx(brute("▁" + w))
        assert np.exp(langid.log_forward_long("▁" + w, s, p)[0]) == pytest.approx(brute("▁" + w))


def test_cuts_equal_lookups():
    rng = random.Random(11)
    pieces = list({"".join(rng.choices("abcdéß語", k=rng.randrange(1, 18))) for _ in range(3000)})
    s = langid.Segmenter({x: k for k, x in enumerate(pieces)})
    for n in (1, 2, 9, 30):
        some = ["".join(rng.choices("abcdéß語x", k=n)) for _ in range(50)]
        got = s.cuts(some)
        for w, own in zip(some, got):
            for i in range(1, n + 1):
                for m in range(1, langid.MAX_PIECE + 1):
                    expected = s.index.get(w[i - m : i], len(pieces) + (m == 1)) if m <= i else len(pieces)
                    assert own[i - 1, m - 1] == expected


def test_words_of_any_length_are_learned_from(spark):
    pieces = ["▁a", "▁", "a", "b", "ab", "▁ab", "bab", "aba"]
    s = langid.Segmenter({x: k for k, x in enumerate(pieces)})
    p = np.array([0.1, 0.2, 0.3, 0.05, 0.15, 0.2, 0.1, 0.07, 0.0, 1e-9])
    rng = random.Random(2)
    for n in (1, 2, 7, 30):
        word = "".join(rng.choices("abc", k=n))
        long = langid.expected_counts_long("▁" + word, s, p)
        assert langid.expected_counts([word], np.ones(1), s, p) == pytest.approx([long.get(k, 0.0) for k in range(s.size)])
    counts = langid.expected_counts(["ab" * 3000, "ab"], np.array([2.0, 1.0]), s, p)
    assert sum(c * len(x) for c, x in zip(counts, pieces)) == pytest.approx(2 * 6001 + 3)
    # Texts without spaces: every text is one long word.
    parts = {"aa": "のにはをたが", "bb": "的一是不了在"}
    rows = [(k, "".join(rng.choices(parts[x], k=300)), x) for k in range(40) for x in [("aa", "bb")[k % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(df.filter("doc_id >= 20"), langid.fit(df.filter("doc_id < 20"))).collect()
    assert len(found) == 20 and all(r.lang == r.lang_pred for r in found)


def test_texts_in_no_learned_language_are_known(two_languages, spark):
    model = langid.fit(two_languages)
    strange = docs(spark, ["Ωμέγα και άλφα " * 5, "русский текст здесь " * 5, None, "123"])
    assert not any(r.known for r in langid.predict(strange, model).select(langid.known_language(F.col("letter_log")).alias("known")).collect())
    assert all(r.known for r in langid.predict(two_languages, model).select(langid.known_language(F.col("letter_log")).alias("known")).collect())


def test_columns_of_any_name_pass_or_are_replaced(spark, two_languages):
    df = two_languages.withColumns({"__text": F.lit("der ung"), "score": F.lit("old"), "letter_log": F.lit(1), "predicted": F.lit("p"), "n_removed": F.lit("r"), "spans": F.lit(0), "text of the row": F.lit("x")})
    model = langid.fit(df)
    found = langid.predict(df, model)
    assert found.columns == ["doc_id", "text", "lang", "__text", "predicted", "n_removed", "spans", "text of the row", "lang_pred", "score", "letter_log"]
    assert all(r.lang == r.lang_pred for r in found.collect())
    w = np.zeros((1 << quality.HASH_BITS) + 1, np.float32)
    assert quality.predict(df, w).columns[-2:] == ["score", "predicted"] and {r.score for r in quality.predict(df, w).collect()} == {0.5}
    cleaned = linededup.dedup_lines(df)
    assert cleaned.columns.count("n_removed") == 1 and {r.n_removed for r in cleaned.collect()} == {0}
    assert simhash.keep_one(df).columns == df.columns


def test_null_ids_are_kept(spark):
    rng = random.Random(8)
    text = words(rng, 60)
    df = spark.createDataFrame([(None, text, "en"), (None, text, "en"), (None, None, "en"), (4, text, "en"), (5, words(rng, 60), "fr")], "doc_id long, text string, lang string")
    n = df.count()
    assert langid.predict(df, langid.fit(df)).count() == n
    assert quality.predict(df, np.zeros((1 << quality.HASH_BITS) + 1, np.float32)).count() == n
    assert sorted(r.component_id or 0 for r in simhash.near_duplicates(df).collect()) == [0, 4, 4, 4, 5]
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(df).collect()) == [0, 4, 5]
    assert licenses.scan_licenses(df).count() == media.media_columns(df).count() == linededup.dedup_lines(df).count() == packing.pack(df).count() == n
    bench = spark.createDataFrame([(None, text)], "item_id long, text string")
    assert sorted(r.doc_id or 0 for r in decontam.find_leaks(df, bench).collect()) == [0, 0, 4]
    assert sorted(r.doc_id or 0 for r in decontam.drop_leaks(df, bench).collect()) in ([5], [0, 5])


def test_expected_counts_sum_to_pieces_per_word():
    pieces = ["▁a", "▁", "a", "b", "ab", "▁ab"]
    s = langid.Segmenter({x: k for k, x in enumerate(pieces)})
    p = np.array([0.1, 0.2, 0.3, 0.05, 0.15, 0.2, 0.0, 1e-9])
    counts = langid.expected_counts(["ab"], np.array([3.0]), s, p)
    cover = sum(c * len(x) for c, x in zip(counts, pieces))
    assert cover == pytest.approx(3 * len("▁ab"))


@needs_tables
def test_language_of_held_out_documents(spark):
    found = QUERIES["op1_language_id"](spark, str(TABLES)).join(common.read_table(spark, str(TABLES), "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.9


# ------------------------------------------------------------ quality


@needs_tables
def test_quality_of_held_out_documents(spark):
    found = QUERIES["op2_quality"](spark, str(TABLES)).join(common.read_table(spark, str(TABLES), "labels"), "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert sum(r.quality == (r.score >= 0.5) for r in found) / len(found) > 0.8


def test_scores_equal_brute_force(spark):
    """Features, updates and scores written out with dictionaries, gram by gram."""
    import re
    from math import exp, sqrt

    rng = random.Random(4)
    texts = [None, "", "one", "2024 was 99"] + [f"{words(rng, rng.randrange(1, 40), 50)} {rng.choice(['!!', 'ok ok', '17'])}" for _ in range(40)]
    labels = [k % 2 for k in range(len(texts))]

    def mix(x):
        x = x * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ (x >> 29)) * 0x9E3779B97F4A7C15 % 2**64
        return x >> (64 - quality.HASH_BITS)

    def vector(text):
        said = (text or "").split()
        word = [zlib.crc32(w.lower().encode()) for w in said]
        shape = [zlib.crc32(re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", "a", w)).encode()) for w in said]
        shape = [ord("=") if k and word[k] == word[k - 1] else x for k, x in enumerate(shape)]
        out = defaultdict(float)
        for h, single, double in ((word, 0x51, 0xA7), (shape, 0xC3, 0xE9)):
            for grams in ([mix(a + single) for a in h], [mix(a * 0x9E3779B97F4A7C15 + b + double) for a, b in zip(h, h[1:])]):
                counts = Counter(grams)
                for slot, n in counts.items():
                    out[slot] += n / sqrt(sum(m * m for m in counts.values()))
        return dict(out) | {"bias": 1.0}

    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - quality.L1 * (1 if z[i] > 0 else -1)) / ((quality.BETA + sqrt(n[i])) / quality.ALPHA + quality.L2)

    def score(x):
        return 1 / (1 + exp(-sum(weight(i) * v for i, v in x.items())))

    df = docs(spark, texts)
    order = [r.doc_id for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").collect()]
    for _ in range(quality.EPOCHS):
        for k in order:
            x = vector(texts[k])
            g = score(x) - labels[k]
            w = {i: weight(i) for i in x}
            for i, v in x.items():
                z[i] += g * v - (sqrt(n[i] + (g * v) ** 2) - sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += (g * v) ** 2
    learned = quality.fit(df.withColumn("quality", (F.col("doc_id") % 2).cast("int")))
    found = {r.doc_id: r.score for r in quality.predict(df, learned).collect()}
    assert [found[k] for k in range(len(texts))] == pytest.approx([score(vector(t)) for t in texts], abs=1e-4)


def test_ftrl_separates():
    rows = [quality.features("good fine text"), quality.features("bad *** junk")] * 30
    w = quality.train_ftrl(rows, [1, 0] * 30)
    scores = [quality.sigmoid(float(w[s] @ v + w[-1])) for s, v in rows[:2]]
    assert scores[0] > 0.9 and scores[1] < 0.1


# ------------------------------------------------------------ conversations


def test_snapshots_collapse(spark):
    said = [("user", "a"), ("assistant", "b"), ("user", "c")]
    logs = {1: said[:1], 2: said[:2], 3: said, 4: said, 5: [("user", "a"), ("assistant", "x")], 6: said[1:]}
    rows = [(c, k, r, t) for c, turns in logs.items() for k, (r, t) in enumerate(turns)] + [(3, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.n_turns) for r in conversations.maximal(turns).collect()) == [(3, 3), (5, 2), (6, 2)]
    rendered = {r.conv_id: r.rendered for r in conversations.render(turns, conversations.maximal(turns)).collect()}
    assert rendered[5] == "<|user|>\na<|end|>\n<|assistant|>\nx<|end|>\n"
    assert conversations.render(turns.limit(0), conversations.maximal(turns.limit(0))).count() == 0


def test_chat_odd_rows_equal_sql(spark):
    """Null ids, turns, roles and texts, turn numbers that repeat, repeated rows, clashing column names."""
    rng = random.Random(6)
    pick = lambda *xs: rng.choice(xs)
    rows = [(pick(None, *range(12)), pick(None, 0, 0, 1, 2, 600), pick(None, "user", "assistant"), pick(None, "", "a", "b", "long " * 300)) for _ in range(160)] + [(k, 0, "user", "hot") for k in range(20, 60)]
    rows += rows[:30]
    schema = "conv_id long, turn long, role string, text string"
    for given in (rows, rows[:5], [], [(None, None, None, None)] * 3):
        turns = spark.createDataFrame(given, schema).withColumns({x: F.lit("x") for x in ("position", "x1", "h1", "block", "tie", "n_turns", "c")})
        found = conversations.render(turns, conversations.maximal(turns))
        con = duckdb.connect()
        con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
        if given:
            con.executemany("insert into conversations values (?, ?, ?, ?)", given)
        assert Counter(map(tuple, found.collect())) == Counter(con.sql(conversations.oracle()).fetchall())


def test_long_conversations_go_by_blocks(spark):
    n = 3 * conversations.BLOCK_TURNS
    rows = [(c, k, "user", str(k)) for c, m in ((1, n), (2, n - 700), (3, conversations.BLOCK_TURNS)) for k in range(m)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in conversations.maximal(turns).collect()] == [(1, n)]


# ------------------------------------------------------------ WARC


def test_archives_round_trip(spark, tmp_path):
    html = ["<p>one</p>", "<p>two</p>", "<p>one</p>", None, "", "ü" * 5000, "<p>one</p>"]
    urls = ["http://b.org/x", "http://a.org/", "https://B.org/x#frag", None, "http://a.org/?q=1", "http://a.org/ü x", "not a url"]
    rows = [(10 - k, u, h) for k, (u, h) in enumerate(zip(urls, html))] + [(10, urls[0], html[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"file": F.lit("f"), "same": F.lit(1), "n": F.lit(2), "payload": F.lit("p")})
    folder = f"file://{tmp_path}/w"
    index = warc.merge_index(warc.write_archives(pages.repartition(3), folder), folder)
    records = warc.read_archives(index, folder, with_payload=True).collect()
    assert len(records) == 8
    for r in records:
        h = (html[10 - r.page_id] or "").encode()
        least = min(10 - k for k, x in enumerate(html) if (x or "").encode() == h)
        assert (r.payload_bytes, r.payload_digest) == (len(h), warc.digest(h))
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == least else ("revisit", least))
        assert r.payload == (h if r.page_id == least else None)
    merged = index.orderBy("capture_order").collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in merged]
    assert keys == sorted(keys) and [r.capture_order for r in merged] == list(range(8))
    assert warc.url_key("https://User@B.org:80/x#frag") == "org,b)/x"


@pytest.mark.parametrize("fan_in", [2, 64])
def test_runs_merge_in_passes_over_ranges(spark, tmp_path, monkeypatch, fan_in):
    for name, value in (("FILE_BYTES", 1 << 12), ("RUN_ROWS", 4), ("RANGE_FENCES", 6)):
        monkeypatch.setattr(warc, name, value)
    rng = random.Random(5)
    urls = ["http://hot.org/"] * 150 + [f"http://h{rng.randrange(9)}.org/{rng.randrange(30)}" for _ in range(150)]
    rows = [(None if k % 50 == 0 else k, u, f"<p>{rng.random()}</p>" if k % 3 else "same") for k, u in enumerate(urls)]
    folder = f"file://{tmp_path}/w"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    # The limits hold for workers too, as the functions take their module's values along.
    fences = warc.write_archives(pages, folder)
    merged = warc.merge_index(fences, folder, fan_in=fan_in).orderBy("capture_order").collect()
    keys = [(r.url_key, r.captured, r.page_id is None, r.page_id or 0, r.file, r.position) for r in merged]
    assert keys == sorted(keys) and [r.capture_order for r in merged] == list(range(300))
    assert Counter((r.page_id, r.url_key) for r in merged) == Counter((i, warc.url_key(u)) for i, u, _ in rows)


def test_archives_of_no_pages_and_of_text_ids(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    schema = "page_id string, url string, html string"
    for rows in ([], [("a b/<ü>", "http://x.org/", "h"), ("", None, "h"), (None, "http://x.org/", None), ("a b/<ü>", "http://x.org/", "other")]):
        index = warc.merge_index(warc.write_archives(spark.createDataFrame(rows, schema), folder), folder)
        found = warc.read_archives(index, folder, with_payload=True).collect()
        assert Counter((r.page_id, r.payload_bytes) for r in found) == Counter((i, len(h or "")) for i, _, h in rows)
        assert index.count() == len(rows)


@needs_tables
def test_roles_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{TABLES}/pages.parquet'")
    expected = con.sql("select page_id, octet_length(encode(coalesce(html, ''))), case when page_id = min(page_id) over w then 'response' else 'revisit' end, case when page_id > min(page_id) over w then min(page_id) over w end from pages window w as (partition by coalesce(html, ''))").fetchall()
    found = QUERIES["op4_warc"](spark, str(TABLES)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or -1) for r in found) == sorted((a, b, c, d or -1) for a, b, c, d in expected)
    assert sorted(r.capture_order for r in found) == list(range(len(found)))


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 5, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], key=lambda x: x)) == sorted(x for r in runs for x in r)


# ------------------------------------------------------------ SimHash


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    base = [words(rng, n) for n in (3, 8, 40, 200)]
    texts = [t for b in base for t in [b] * 3 + [b.replace(b.split()[0], "other", 1)] + [b + " " + words(rng, 1) for _ in range(60)]] + [None, "", "One Two", "one two"]
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [found[k].fingerprint for k in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [found[k].component_id for k in range(len(texts))] == brute_components(fps)
    kept = {r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()}
    assert kept == set(brute_components(fps))


@pytest.mark.parametrize("n", [30, 400])
def test_links_equal_brute_force_on_both_paths(spark, n):
    """Few fingerprints meet pairwise; many near one centre take the path through words one bit away."""
    rng = random.Random(n)
    centre = rng.getrandbits(64)
    fps = list({centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ ((1 << rng.randrange(64)) if rng.random() < 0.5 else 0) for _ in range(n)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    comps = {r.node: r.component for r in components.components(simhash.links(df)).collect()}
    groups, expected = defaultdict(set), defaultdict(set)
    for k, r in enumerate(brute_components(fps)):
        expected[r].add(signed[k])
    for f in signed:
        groups[comps.get(f, f)].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 3000)
    keys = golay.keys(w)
    assert (golay.ERRORS[:, 0] >= 0).all()
    for flips in range(3):
        v = w.copy()
        for _ in range(flips):
            v ^= 1 << rng.integers(0, 23, len(v))
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys, golay.keys(v)))


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {k: 0 for k in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components.components(edges.limit(0)).count() == 0


# ------------------------------------------------------------ decontamination


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(20)], [rng.randrange(6) for _ in range(40)]
        assert decontam.common_subsequence(decontam._places(np.array(a)), len(a), b) == lcs(a, b)


def test_common_subsequences_of_many_texts():
    rng = np.random.default_rng(3)
    lengths, texts = np.array([1, 20, 63, 64]), rng.integers(-1, 12, (80, 150))
    items, which = [rng.integers(0, 9, n) for n in lengths], rng.integers(0, 4, 80)
    found = decontam.common_subsequences([decontam._places(x) for x in items], lengths, which, texts, 12)
    assert found.tolist() == [lcs(items[k].tolist(), t.tolist()) for k, t in zip(which, texts)]


def test_groups_of_candidates_cover_all():
    rng = np.random.default_rng(4)
    for most in (1, 3, 1000):
        counts, lengths = rng.integers(1, 9000, 12), rng.choice([5, 64, 65, 300], 12)
        of_item, size = np.repeat(np.arange(12), counts), np.repeat(lengths, counts)
        groups = list(decontam._groups(of_item, size, most))
        assert [a for a, _ in groups] == [0, *(z for _, z in groups[:-1])] and groups[-1][1] == len(of_item)
        for a, z in groups:
            own = np.unique(of_item[a:z])
            assert 0 < z - a <= 4096 and (len(own) == 1 or size[a:z].max() <= 64) and len(own) <= most
    assert list(decontam._groups(np.zeros(0, int), np.zeros(0, int), 5)) == []


def test_segment_sums():
    rng = np.random.default_rng(5)
    matrix, lengths = rng.standard_normal((50, 7)), rng.integers(1, 90, 40)
    rows, heads = rng.integers(0, 50, lengths.sum()), np.cumsum(lengths) - lengths
    assert np.allclose(decontam.segment_sums(matrix, rows, heads), np.add.reduceat(matrix[rows], heads, axis=0))
    assert np.allclose(decontam.segment_sums(matrix, rows[:40], np.arange(40)), matrix[rows[:40]])


def test_short_items_with_scattered_changes_are_found(spark):
    """Short items with two words changed, so no eight stand in one piece, among other words of the benchmark."""
    rng = random.Random(31)
    items = [words(rng, 12, 800) for _ in range(150)]
    texts = []
    for item in items:
        body = words(rng, 200, 800).split()
        at = rng.randrange(200)
        body[at:at] = [w if k not in (4, 8) else "changed" for k, w in enumerate(item.split())]
        texts.append(" ".join(body))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs(spark, texts), bench).collect()} >= {(k, k) for k in range(150)}


def test_leaks_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(9)
    items = [words(rng, n, 3000) for n in (14, 20, 36, 59, 100, 150)]
    texts, expected = [], set()
    for k in range(120):
        body = words(rng, 300, 3000).split()
        if k % 4 == 0:
            item = k // 4 % len(items)
            own = items[item].split()
            if k % 8 == 0:  # a paraphrase: one word in ten replaced
                own = [w if i % 10 else "changed" for i, w in enumerate(own)]
            at = rng.randrange(300)
            body[at:at] = own
            expected.add((k, item))
        texts.append(" ".join(body).capitalize() + ".")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs(spark, texts), bench).collect()}
    assert found == expected
    assert decontam.drop_leaks(docs(spark, texts), bench).count() == 90


@pytest.mark.parametrize("length", [5, 36])
def test_an_item_that_leaks_into_a_third_of_the_rows_is_found(spark, length):
    rng = random.Random(21)
    items = [words(rng, length, 3000)] + [words(rng, 40, 3000) for _ in range(30)]
    copy = words(rng, 30, 3000) + " " + items[0]
    edited = " ".join(w if k % 12 else "changed" for k, w in enumerate(items[0].split()))
    texts = [copy if k % 3 == 0 else words(rng, 30, 3000) + " " + edited if k % 30 == 1 and length > 20 else words(rng, 60, 3000) for k in range(150)]
    expected = {(k, 0) for k in range(150) if k % 3 == 0 or k % 30 == 1 and length > 20}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs(spark, texts), bench).collect()} == expected


def test_runs_of_item_words():
    bench = decontam.Benchmark([0, 1, 2], [np.arange(12), np.arange(4, 16), np.array([3, 1])], {})
    texts = [[-1, *range(9), -1], [3, 1, 3], [1], [], [*range(4, 12), 3], [1]]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    at, owner = decontam.gram_hits(np.array([w for t in texts for w in t]), starts, decontam.item_grams(bench))
    brute = {(int(starts[d]) + k, i) for d, t in enumerate(texts) for k in range(len(t)) for i, x in enumerate(bench.ids) for n in [min(8, len(x))] for j in range(len(x) - n + 1) if t[k : k + n] == x[j : j + n].tolist()}
    assert set(zip(at.tolist(), owner.tolist())) == brute and len(brute) == 5


@needs_tables
def test_verbatim_items_of_the_tables_are_found(spark):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontamination"](spark, str(TABLES)).collect()}
    items = common.read_table(spark, str(TABLES), "benchmark").collect()
    norm = lambda t: " ".join(x.decode() for x in decontam.words_of(t))
    exact = {(d.doc_id, i.item_id) for d in common.read_table(spark, str(TABLES), "documents").collect() for i in items if f" {norm(i.text)} " in f" {norm(d.text)} "}
    assert exact <= found


def brute_leaks(texts, items):
    """(text, item) by number: the rule tried on a window from every word on, without any retrieval."""
    found = set()
    for d, text in enumerate(texts):
        said = decontam.words_of(text)
        for i, item in enumerate(items):
            own = decontam.words_of(item)
            number = {w: k for k, w in enumerate(dict.fromkeys(own))}
            where = decontam._places(np.array([number[w] for w in own]))
            ids = [number.get(w, -1) for w in said]
            for s in range(len(said)):
                window = ids[max(0, s - len(own)) : s + decontam.PASSAGE + len(own)]
                shared = decontam.common_subsequence(where, len(own), window)
                last = [number[w] for w in own][-decontam.ANSWER_WORDS :]
                answered = any(window[k : k + len(last)] == last for k in range(len(window)))
                if shared >= decontam.MIN_OVERLAP * len(own) or answered and shared >= decontam.MIN_PARAPHRASE * len(own):
                    found.add((d, i))
                    break
    return found


@pytest.mark.parametrize("block_bytes, sum_bytes", [(decontam.BLOCK_BYTES, decontam.SUM_BYTES), (500, 1 << 14)])
def test_leaks_equal_the_subsequence_rule_over_all_windows(spark, monkeypatch, block_bytes, sum_bytes):
    """No cosine, no grams: the rule tried on a window from every word on; also in blocks of items and of columns."""
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", ("text", block_bytes))
    monkeypatch.setattr(decontam, "SUM_BYTES", sum_bytes)
    rng = random.Random(12)
    items = [words(rng, n, 900) for n in (9, 20, 33, 36, 64, 90)] + ["the of and to the of and to in"]
    texts = [None, "", "the of and to the of and to in"]
    for k in range(70):
        body = words(rng, rng.randrange(5, 160), 900).split()
        item = items[k % len(items)].split()
        rate, answer = rng.choice([0.0, 0.1, 0.2, 0.3, 0.45, 0.6]), k % 3
        own = [w if rng.random() >= rate or answer == 0 and i >= len(item) - 8 else f"w{rng.randrange(900)}" for i, w in enumerate(item)]
        at = rng.randrange(len(body))
        texts.append(" ".join(body[:at] + own + body[at:]))
    expected = brute_leaks(texts, items)
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert found <= expected and len(expected) > 40 and len(expected - found) <= len(expected) // 50


# ------------------------------------------------------------ licences


def test_license_places(spark):
    texts = ["CC BY and cc-by. cc by", "GNU General Public\nLicense", "all rights, reserved! All Rights", "license general public", None, "This work is licenced under a Creative Commons attribution license", "permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated docs", "\u212a cc by \u0130 of a\u212a"]
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels, rows[0].n_words) == (3, 0, 5, "cc-by", 7)
    assert (rows[1].n_base, rows[1].base_labels) == (1, "gpl") and (rows[2].n_base, rows[2].base_labels, rows[2].score) == (1, "reserved", 1.0)
    assert (rows[3].n_base, rows[3].first_word, rows[3].base_labels) == (0, None, "") and rows[4].n_words == 0
    # Only A to Z are lowered: the Kelvin sign is no k.
    assert (rows[7].n_words, rows[7].n_base, rows[7].first_word) == (6, 1, 1)
    assert rows[5].labels == "cc-notice" and rows[6].labels == "mit-notice" and rows[6].n_base == 0


# ------------------------------------------------------------ line dedup


def test_repeated_chunks_go_and_first_ones_stay(spark):
    rng = random.Random(6)
    passage = "\n".join(words(rng, 12) for _ in range(30))
    own = ["\n".join(words(rng, 9) for _ in range(8)) for _ in range(6)]
    texts = [f"{own[0]}\n{passage}", f"{own[1]}\n{passage}\n{own[2]}", own[3], own[3], own[4], "short\nlines", "short\nlines"]
    out = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert out[0].text == texts[0] and out[2].text == texts[2] and out[4].text == texts[4]
    left = out[1].text.split("\n")
    assert set(own[1].split("\n") + own[2].split("\n")) <= set(left) and sum(x in passage.split("\n") for x in left) <= 10
    assert out[3].text == "" and out[3].n_removed > 0 and out[6].text == "" and out[5].text == texts[5]


def brute_line_dedup(texts, with_chunks=True):
    """The rule in plain loops, without the operator's code: texts in order of their ids, lines as bytes."""
    multiplier, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def cut(lines):
        """(first, after) line numbers of the chunks."""
        h = [xxhash.xxh64_intdigest(x) for x in lines]
        value = [(h[i] + (h[i - 1] * multiplier if i else 0)) & mask for i in range(len(lines))]
        value = [v ^ (v >> 29) for v in value]
        long = [len(x.split()) >= 50 for x in lines]
        out, first = [], 0
        for i in range(len(lines)):
            low = 1 <= i < len(lines) - 2 and value[i] < value[i - 1] and value[i] <= value[i + 1]
            if i + 1 == len(lines) or low or long[i] or long[i + 1] or i + 1 - first == 64:
                out.append((first, i + 1))
                first = i + 1
        return out

    docs = [(text or "").encode().split(b"\n") for text in texts]
    gone = [[False] * len(lines) for lines in docs]
    parts = [cut(lines) for lines in docs]
    first = {}
    found = []  # doc, first line, line after, chunk number or None
    for d, lines in enumerate(docs):
        if with_chunks:
            found += [(d, a, b, k) for k, (a, b) in enumerate(parts[d]) if (b - a > 1 or len(lines[a].split()) >= 50) and any(x.strip() for x in lines[a:b])]
        full = [i for i, x in enumerate(lines) if x.strip()]
        found += [(d, i, j + 1, None) for i, j in zip(full, full[1:]) if len(lines[i].split()) + len(lines[j].split()) >= 12]
    for place in sorted(found, key=lambda x: (x[0], x[1], x[3] is None)):
        first.setdefault(tuple(docs[place[0]][place[1] : place[2]]), place)
    for d, a, b, k in found:
        e, c, _, m = first[tuple(docs[d][a:b])]
        if (d, a) == (e, c):
            continue
        gone[d][a:b] = [True] * (b - a)
        if k is None or m is None:
            continue
        here, there = docs[d], docs[e]
        for step, edge, other, at, to in ((-1, parts[d][k - 1][0] if k else a, parts[e][m - 1][0] if m else c, a - 1, c - 1), (1, parts[d][k + 1][1] - 1 if k + 1 < len(parts[d]) else b - 1, parts[e][m + 1][1] - 1 if m + 1 < len(parts[e]) else c + b - a - 1, b, c + b - a)):
            run = []
            while (at >= edge and to >= other if step < 0 else at <= edge and to <= other) and here[at] == there[to]:
                run.append(at)
                at, to = at + step, to + step
            if any(here[i] for i in run):
                for i in run:
                    gone[d][i] = True
    return [None if text is None else "\n".join(x.decode() for x, g in zip(docs[d], gone[d]) if not g) for d, text in enumerate(texts)]


def line_corpus(rng):
    lines = [words(rng, rng.randrange(1, 9), 60) for _ in range(40)] + [words(rng, rng.randrange(8, 15), 300) for _ in range(30)] + [words(rng, 55, 400) for _ in range(4)] + ["", "  ", "\t"]
    passage = [words(rng, rng.randrange(1, 12)) for _ in range(20)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14))) for _ in range(60)] + ["same\nlines\nhere"] * 90 + [None, "", "\n"] + ["one line\n" * 200, "one line\n" * 150 + "end"]
    for _ in range(30):
        a = rng.randrange(16)
        texts.append("\n".join([words(rng, 3), *passage[a : a + rng.randrange(2, 14)], words(rng, 4), *(rng.choice(lines) for _ in range(3))]))
    return texts


@pytest.mark.parametrize("seed", [17, 18, 19])
def test_line_dedup_equals_brute_force(spark, seed):
    texts = line_corpus(random.Random(seed))
    found = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert [found[k] for k in range(len(texts))] == brute_line_dedup(texts)


def test_chunks_carry_the_result(spark, monkeypatch):
    """Without chunks, or without their extension, other texts come out."""
    texts = line_corpus(random.Random(17))
    whole = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    alone = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, texts), few_words=None).collect()}
    short = lambda own: sum(len(t or "") for t in own.values())
    assert short(whole) < short(alone) < sum(len(t or "") for t in texts)
    monkeypatch.setattr(linededup, "_extended", lambda met: met.select(*linededup.PLACE, *linededup.CHUNK, "first").limit(0))
    unextended = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, texts), few_words=None).collect()}
    assert short(alone) < short(unextended)
    second_step_alone = brute_line_dedup(texts, with_chunks=False)
    assert short(whole) < sum(len(t or "") for t in second_step_alone) and [whole[k] for k in range(len(texts))] != second_step_alone


def test_lines_beside_columns_of_any_name(spark):
    df = docs(spark, ["same line of many words\nand one more line here\nx y", "a b\nsame line of many words\nand one more line here\nx y"]).withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit("x"))
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_removed", "removed_bytes"] and out.count() == 2
    model = langid.fit(df)
    assert langid.predict(df, model).columns[: len(df.columns)] == df.columns and langid.predict(df, model).count() == 2
    assert quality.predict(df, np.zeros((1 << quality.HASH_BITS) + 1, np.float32)).count() == 2


def test_chunks_cover_a_text_and_shift_with_it():
    rng = random.Random(8)
    data = "\n".join(words(rng, 5) for _ in range(60)).encode()
    spans = linededup.chunks(data)
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(b[0] == a[1] + 1 for a, b in zip(spans, spans[1:])) and sum(n for _, _, n in spans) == 60
    moved = linededup.chunks(b"one more line\n" + data)
    shift = len(b"one more line\n")
    assert len({(a + shift, b + shift) for a, b, _ in spans} - {(a, b) for a, b, _ in moved}) <= 2 and all(n > 1 for _, _, n in spans)
    assert linededup.remove(b"a\nb\nc", [(0, 1), (4, 5)]) == b"b" and linededup.remove(b"a\nb", [(0, 3)]) == b""


def test_passages_of_few_lines_go_in_any_context(spark):
    """One long line, or two to six lines of any length, between other lines; the first place stays whole."""
    rng = random.Random(12)
    parts = [[words(rng, 60)], *([words(rng, m) for _ in range(n)] for n in range(2, 7) for m in (7, 55)), [words(rng, 8), "", words(rng, 9)]]
    texts, around = [], []
    for k in range(2 * len(parts)):
        before, after = ([words(rng, 9) for _ in range(rng.randrange(4))] for _ in range(2))
        around.append(before + after)
        texts.append("\n".join(before + parts[k % len(parts)] + after))
    texts += [words(rng, 49) + "\n" + x for x in ("a b", "c d")] + ["e\n" + words(random.Random(13), 49) + "\nf", "g\n" + words(random.Random(13), 49)]
    out = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    n = len(parts)
    assert all(out[k].text == texts[k] and out[k].n_removed == 0 for k in [*range(n), *range(2 * n, len(texts))])
    for k in range(n, 2 * n):
        assert (out[k].text, out[k].n_removed, out[k].removed_bytes) == ("\n".join(around[k]), 1, len("\n".join(parts[k - n])))


# ------------------------------------------------------------ media


@pytest.mark.parametrize("transforms", [None, (), (0,), (1,), (2,), (0, 1, 2), (2, 0), (3,)])
@pytest.mark.parametrize("cache_bits, by_frequency", [(0, False), (1, True), (6, False), (6, True)])
def test_webp_round_trip(transforms, cache_bits, by_frequency):
    rng = np.random.default_rng(5)
    for width, height in ((1, 1), (5, 7), (16, 9), (33, 12)):
        n = width * height
        px = np.repeat(rng.integers(0, 256, (n // 3 + 1, 4)), 3, axis=0)[:n].astype(np.uint8)
        if transforms == (3,):
            px = rng.integers(0, 256, (9, 4)).astype(np.uint8)[rng.integers(0, 1 + min(8, n // 8), n)]
        data = webp.encode(px, width, height, transforms, 2, modes=np.arange(14), elements=rng.integers(0, 256, (5, 3)), cache_bits=cache_bits, by_frequency=by_frequency)
        w, h, back = webp.decode(data)
        assert (w, h) == (width, height) and (back == px).all()


def features_of(data):
    """Which transforms a file has, and whether its image has a colour cache and codes of several lengths."""
    seen, cached, uneven = [], [], []
    bits = webp.Bits(data[20:])
    bits.skip(8 + 14 + 14 + 1 + 3)
    code, read_pixels = webp.read_code, webp._read_pixels

    def spy_code(bits, alphabet):
        found = code(bits, alphabet)
        uneven.append(len(set(found.lengths.tolist())) > 1)
        return found

    def spy_pixels(bits, codes, n, width, cache_bits):
        cached.append(cache_bits)
        return read_pixels(bits, codes, n, width, cache_bits)

    webp.read_code, webp._read_pixels = spy_code, spy_pixels
    undone = {k: getattr(webp, k) for k in ("predictor", "cross_colour", "subtract_green")}
    for k, f in undone.items():
        setattr(webp, k, lambda *a, k=k, f=f: (seen.append(k), f(*a))[1])
    try:
        pixels = webp.decode(data)[2]
    finally:
        webp.read_code, webp._read_pixels = code, read_pixels
        for k, f in undone.items():
            setattr(webp, k, f)
    return pixels, set(seen), cached[-1], any(uneven)


def test_webp_features_are_chosen_where_they_pay():
    rng = np.random.default_rng(21)
    y, x = np.mgrid[0:64, 0:64]
    noise = rng.integers(0, 3, (64, 64))
    slope = np.stack([3 * x + noise, 2 * y + x, x + y + noise, np.full_like(x, 255)], axis=-1).astype(np.uint8).reshape(-1, 4)
    pixels, seen, _, uneven = features_of(webp.encode(slope, 64, 64))
    assert (pixels == slope).all() and "predictor" in seen and uneven
    green = rng.integers(0, 120, (64, 64))
    tied = np.stack([green // 2 + noise, green, green // 4 + noise, rng.integers(0, 99, (64, 64))], axis=-1).astype(np.uint8).reshape(-1, 4)
    pixels, seen, _, _ = features_of(webp.encode(tied, 64, 64))
    assert (pixels == tied).all() and "cross_colour" in seen
    equal = np.stack([green + noise, green, green + noise, green], axis=-1).astype(np.uint8).reshape(-1, 4)
    pixels, seen, _, _ = features_of(webp.encode(equal, 64, 64))
    assert (pixels == equal).all() and "subtract_green" in seen
    few = rng.integers(0, 256, (400, 4)).astype(np.uint8)[rng.zipf(1.3, 4096) % 400]
    pixels, _, cache_bits, _ = features_of(webp.encode(few, 64, 64))
    assert (pixels == few).all() and cache_bits > 0
    text = np.frombuffer(media.padded((words(random.Random(3), 700, 90) + ".").encode()), np.uint8).reshape(-1, 4)
    data = media.to_media(text.tobytes())
    pixels, _, _, uneven = features_of(data)
    assert (pixels.reshape(-1)[: text.size] == text.reshape(-1)).all() and uneven and data == media.to_media(text.tobytes())


def test_webp_with_groups_of_codes_and_a_cache():
    """A stream put together by hand: two tiles with codes of their own, a reference and a cached colour."""
    rng = np.random.default_rng(9)
    width, height, cache_bits = 8, 4, 3
    px = rng.integers(0, 40, (width * height, 4)).astype(np.uint8)
    px[9] = px[8]
    px[16:20] = px[12:16]
    slots = webp._cache_slots(webp._argb(px), cache_bits)
    w = webp.Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), (0, 1), (1, 1), (cache_bits, 4), (1, 1), (0, 3)):
        w.put(value, n)
    webp.write_image(w, np.array([[0, 0, 0, 255], [0, 1, 0, 255]], np.uint8), False)
    tile = np.arange(width * height) % width >> 2
    codes = []
    for group in (0, 1):
        own = px[tile == group]
        counts = [np.bincount(own[:, c], minlength=256) for c in (1, 0, 2, 3)]
        counts[0] = np.concatenate([counts[0], np.ones(webp.N_LENGTH_CODES + (1 << cache_bits), int)])
        lengths = [webp.huffman_lengths(c) for c in counts] + [webp.huffman_lengths(np.ones(webp.N_DISTANCE_CODES, int))]
        for one in lengths:
            webp.write_code(w, one)
        codes.append([webp.code_arrays(one) for one in lengths])
    at = 0
    while at < len(px):
        own = codes[tile[at]]

        def put(k, symbol):
            w.put(int(own[k][0][symbol]), int(own[k][1][symbol]))

        if at == 9:
            put(0, 256 + webp.N_LENGTH_CODES + int(slots[8]))
            at += 1
        elif at == 16:
            for k, base, number in ((0, 256, 4), (4, 0, 4 + len(webp.NEAR))):
                symbol, extra, more = webp._prefix(number)
                put(k, base + symbol)
                w.put(extra, more)
            at += 4
        else:
            for k, channel in enumerate((1, 0, 2, 3)):
                put(k, int(px[at, channel]))
            at += 1
    data = w.bytes()
    data += b"\0" * (len(data) & 1)
    found = webp.decode(b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data)
    assert found[:2] == (width, height) and (found[2] == px).all()


def test_webp_file_made_elsewhere():
    """A published lossless file of one pixel, made to tell whether a browser reads the format."""
    import base64

    width, height, px = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert (width, height, px.shape) == (1, 1, (1, 4))


def test_uniform_predictors_equal_pixel_by_pixel():
    rng = np.random.default_rng(2)
    for width, height in ((1, 1), (1, 6), (7, 1), (5, 9)):
        px = rng.integers(0, 256, (width * height, 4)).astype(np.uint8)
        for mode in (1, 2):
            image, expected = px.reshape(height, width, 4), np.zeros((height, width, 4), np.uint8)
            for y in range(height):
                for x in range(width):
                    if x == 0 and y == 0:
                        before = np.array([0, 0, 0, 255], np.uint8)
                    elif y == 0 or x and mode == 1:
                        before = image[y, x - 1]
                    else:
                        before = image[y - 1, x]
                    expected[y, x] = image[y, x] - before
            residual = webp.predictor(px, width, height, np.array([mode]), 9, True)
            assert (residual == expected.reshape(-1, 4)).all() and (webp.predictor(residual, width, height, np.array([mode]), 9, False) == px).all()


def test_webp_references_and_broken_files():
    px = np.tile(np.arange(64, dtype=np.uint8).reshape(16, 4), (40, 1))
    data = webp.encode(px, 16, 40, ())
    assert len(data) < 300 and (webp.decode(data)[2] == px).all()
    for bad in (b"", b"RIFF", data[:40], data[:12] + b"VP8 " + data[16:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_webp_with_more_symbols_than_half_an_alphabet():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 256, (120_000, 4)).astype(np.uint8)
    parts, at = [base], len(base)
    for back in np.unique(np.geomspace(20, 119_000, 200).astype(int)):  # references at distances of every order
        parts.append(base[len(base) - back : len(base) - back + 12])
        parts.append(rng.integers(0, 256, (3, 4)).astype(np.uint8))
    px = np.concatenate(parts)
    px = px[: len(px) // 16 * 16]
    w, h, back = webp.decode(webp.encode(px, 16, len(px) // 16))
    assert (back == px).all()
    lengths = webp.flat_lengths(np.arange(37), 40)
    assert len(webp.canonical(lengths)) == 37 and set(lengths[:37]) == {5, 6}


def test_payloads(spark):
    rows = {r.doc_id: r for r in media.media_columns(docs(spark, ODD), with_media=True).collect()}
    import hashlib

    for k, t in enumerate(ODD):
        payload = (t or "").encode()
        payload += b"\0" * (64 if not payload else -len(payload) % 64)
        assert (rows[k].n_bytes, rows[k].payload_bytes, rows[k].payload_sha256, rows[k].tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert rows[k].media_sha256 == hashlib.sha256(rows[k].media).hexdigest() and webp.decode(rows[k].media)[2].tobytes()[: len(payload)] == payload
    assert rows[0].feature == rows[1].feature


# ------------------------------------------------------------ packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_added_tokens_in_a_text_are_the_librarys(spark, tokenizer):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "plain <| endoftext |> words"]
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [31373, 220, 50256, 995]
    found = {r.doc_id: r for r in packing.pack(docs(spark, texts)).collect()}
    for k, ids in enumerate(expected):
        assert (found[k].length, found[k].ids_crc32) == (len(ids) + 1, zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes()))


def test_units_equal_whole_texts(tokenizer):
    rng = random.Random(1)
    alphabet = ["a", "Zebra", "'s", "don't", "12", "7th", "...", "é", "日本", " ", "  ", "\n", "\t", ",", "!?", "\xa0", "²", "x" * 40, "<|endoftext|>", "-", "'ll", "#a"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(300)] + [" ".join(rng.choices(alphabet, k=20)) for _ in range(100)]
    expected = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    e = packing.UnitEncoder(packing.default_tokenizer())
    assert e.encode(texts) == expected and e.encode(texts[::-1]) == expected[::-1]


def test_pieces_and_places(spark, tokenizer):
    rng = random.Random(7)
    texts = ODD + [words(rng, rng.randrange(1, 900)) for _ in range(150)] + ["same text"] * 60
    rows = packing.pack(docs(spark, texts)).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for k, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and (r.length == 1024 or r.piece == 0)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 2


def test_local_search_empties_bins():
    capacity = 100
    classes = {(51, 27): 2, (51, 22): 2, (49,): 2, (26,): 2, (24,): 2}
    after = packing.local_search(classes, capacity)
    items = lambda c: Counter(x for k, n in c.items() for x in k for _ in range(n))
    assert items(after) == items(classes) and all(sum(k) <= capacity for k in after) and sum(after.values()) < sum(classes.values())


def test_best_fit_keeps_all_pieces():
    rng = random.Random(3)
    histogram = Counter(rng.randrange(1, 101) for _ in range(5000))
    classes = packing.best_fit(histogram, 100)
    got = Counter()
    for content, n in classes.items():
        assert sum(content) <= 100
        for x in content:
            got[x] += n
    assert got == histogram and packing.best_fit({}, 100) == {}
    least = -(-sum(k * n for k, n in histogram.items()) // 100)
    assert sum(packing.local_search(classes, 100).values()) <= min(sum(classes.values()), 1.005 * least)


# ------------------------------------------------------------ pipeline


@needs_tables
def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    start = common.read_table(spark, str(TABLES), "documents").withColumn("extra", F.lit(1))
    before, current = start.count(), start
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, str(TABLES)).write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert current.columns == start.columns and current.count() <= before
            before = current.count()
            if name == "near_duplicates":
                assert simhash.near_duplicates(current).filter("doc_id <> component_id").count() == 0
    assert current.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, str(TABLES)).select("doc_id").distinct().count() == before


def test_pipeline_equals_brute_force(spark, tmp_path, tokenizer):
    """All stages against plain loops over a small corpus that holds a case for each."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(23)
    items = [words(rng, n, 700) for n in (12, 30, 40)]
    passage = "\n".join(words(rng, 9, 900) for _ in range(6))
    bodies = ["\n".join(words(rng, rng.randrange(5, 40), 900) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    texts = bodies + bodies[:6] + [f"{bodies[k]}\n{passage}" for k in range(30, 34)] + [passage]
    texts += [f"{words(rng, 60, 900)} {item} {words(rng, 60, 900)}" for item in items] + [f"{words(rng, 50, 900)} {' '.join(w for k, w in enumerate(items[2].split()) if k % 9)}"]
    texts += ["one line only", "one line only", "One  line only", None, "", "12 34 !!", "Ωμέγα και άλφα " * 4, words(rng, 2500, 900)]
    rows = [(3 * k + 1, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = langid.fit(spark.createDataFrame(rows, DOCS).filter(~common.held_out()))
    pieces = langid.Segmenter({x: k for k, x in enumerate(model.pieces)})

    def known(text):
        said = langid.words_of(text)
        if not said:
            return False
        return sum(langid.log_forward_long(langid.WORD_MARK + w, pieces, model.probabilities)[0] for w in said) / sum(map(len, said)) >= np.log(langid.LETTER_FLOOR)

    kept = [(i, t) for i, t, *_ in rows if known(t)]
    assert len(rows) - len(kept) == 4
    after = brute_line_dedup([t for _, t in kept])
    kept = [(i, new) for (i, old), new in zip(kept, after) if new == old or new.strip()]
    groups = brute_components([brute_fingerprint(t) for _, t in kept])
    kept = [x for k, x in enumerate(kept) if groups[k] == k]
    leaks = {d for d, _ in brute_leaks([t for _, t in kept], items)}
    assert len(leaks) == 4
    kept = [x for k, x in enumerate(kept) if k not in leaks]
    expected = set()
    for i, t in kept:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        for piece, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            expected.add((i, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == expected and len(found) == len(expected)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:])) and min(places)[0] == 0 and sum(n for _, n in places) <= 1024
    assert len(bins) <= -(-sum(r.length for r in found) // 1024) + 1


# ------------------------------------------------------------ bounds


def test_a_filter_of_hashes_loses_none(spark):
    from relata.llm.skew import bit_filter, parted

    rows = spark.range(5000).select("id", F.xxhash64("id").alias("mark"), F.lit("x").alias("segment_"))
    kept = rows.filter("id % 7 = 0")
    lone, perhaps = parted(rows, bit_filter(kept, "mark"), "mark")
    assert lone.columns == rows.columns and lone.count() + perhaps.count() == 5000
    assert perhaps.join(kept.select("id"), "id", "left_semi").count() == kept.count() and perhaps.count() <= kept.count() + 10
    lone, perhaps = parted(rows, bit_filter(kept.limit(0), "mark"), "mark")
    assert lone.count() == 5000 and perhaps.count() == 0


def test_leaks_go_beside_columns_of_any_name(spark):
    item = " ".join(f"word{k}" for k in range(30))
    df = docs(spark, [item, "clean text of its own"], leaked=1, __leaked=2).withColumn("a.b", F.lit(3))
    out = decontam.drop_leaks(df, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert out.columns == df.columns and [r.doc_id for r in out.select("doc_id").collect()] == [1]


def test_kept_units_and_words_are_bounded_by_bytes(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_BYTES", 20_000)
    monkeypatch.setattr(packing, "NEW_BYTES", 5_000)
    encoder = packing.UnitEncoder(packing.default_tokenizer())
    rng = random.Random(4)
    for _ in range(12):
        texts = [" ".join("".join(rng.choices("abcdefgh日本", k=rng.choice([3, 8, 300]))) for _ in range(40)) for _ in range(4)]
        assert encoder.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder.held == sum(packing.unit_bytes(u, x) for u, x in encoder.units.items())
    encoder.encode(["a b"])
    assert encoder.held <= 26_000
    known = {}
    quality.features("short " + "x" * 5000 + " short", known)
    assert set(known) == {"short"}


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no generated tables")
def test_every_transform_is_written_and_inverted_on_real_rows(monkeypatch):
    texts = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet' where doc_id < 4000 order by doc_id").fetchall()]
    payloads = [media.padded(t.encode()) for t in texts]
    files = list(media.to_media_many(payloads))
    assert files == [media.to_media(p) for p in payloads[:200]] + files[200:]
    inverted, modes = Counter(), set()

    def counted(name, real):
        def call(*args):
            if not args[-1]:
                inverted[name] += 1
                if name == "predictor":
                    modes.update(np.asarray(args[3]).tolist())
            return real(*args)

        return call

    for name in ("predictor", "cross_colour", "subtract_green"):
        monkeypatch.setattr(webp, name, counted(name, getattr(webp, name)))
    assert all(media.from_media(f, len(p)) == p for f, p in zip(files, payloads))
    varied = sum(media.varied(p) is not None for p in payloads)
    assert varied >= 8 and all(inverted[n] >= varied for n in ("predictor", "cross_colour", "subtract_green")) and modes >= set(range(14))


@pytest.mark.parametrize("used", [[0, 255], [0, 1, 2, 255], [3, 5, 8, 200, 700, 1303], [700, 1252, 1303], [0, 1, 554, 1107], [5, 6, 7], list(range(1304))])
def test_a_code_is_written_in_few_numbers_and_read_back(used):
    counts = np.zeros(1304, np.int64)
    counts[used] = np.arange(1, len(used) + 1)
    lengths, w = webp.huffman_lengths(counts), webp.Writer()
    webp.write_code(w, lengths, 2)
    data = w.bytes()
    assert sum(map(len, w.values)) <= 2 * (len(used) + 2 + 1304 // 552)
    bits = webp.Bits(data)
    for _ in (0, 1):
        code = webp.read_code(bits, 1304)
        n = np.zeros(1304, np.int64)
        n[code.symbols] = code.lengths
        assert n.tolist() == lengths.tolist()
