"""The corpus operators on small frames, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from delaymill.llm import chat, decontaminate, fingerprints, language_id, line_dedup, mixing, ngram_join, quality
from delaymill.llm import token_counts, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and a column with a clashing name."""
    long = "word and more words. " * 3000
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two three four five six", None, "a", 3),
        (3, "one two three four five six", None, "a", 3), (None, "some text without id", "en", None, 1),
        (4, long, "en", "b", 9), (5, "12 34 !!", "de", "b", None), (6, long, "en", "b", 9),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("row", F.lit(1))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts_equal_the_library(spark, odd):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    made = ["".join(rng.choice(" ▁ab\n\t<s>é🙂. the") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for hot in (0, 20, 10_000):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path, hot).collect()}
        assert got == {i: (len(t.encode()), len(model.encode(t))) for i, t in enumerate(made)}
    rows = token_counts.count_tokens(odd, path).collect()
    assert len(rows) == 8 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_kernel_is_shared_grams_over_sizes():
    def sets(t):
        t = " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " "
        t = re.sub(" +", " ", t)
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} - {" "}

    a, b = "Hello, 12 wörld of words", "another wörld; of Ünits"
    marks = language_id.Landmarks.of([language_id.grams(b)])
    want = len(sets(a) & sets(b)) / np.sqrt(len(sets(a)) * len(sets(b)))
    assert marks.kernel([language_id.grams(a)])[0, 0] == pytest.approx(want, rel=1e-6)


def test_language_of_held_out_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()
    rows = language_id.identify(odd).collect()
    assert len(rows) == 8 and all(r.lang_pred == "und" for r in rows if r.doc_id in (1, 2, 5))
    assert language_id.identify(empty(spark)).count() == 0


def test_quality_of_held_out_rows(spark, odd):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out")
    assert got.filter("predicted = quality").count() >= 0.95 * got.count()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}
    assert quality.keep_good(odd, none).columns == odd.columns


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_lines(spark, bits):
    common, rare = "A line that is long enough to count as repeated text", "another line which only two documents have, twice"
    texts = {i: f"  {common.upper() if i % 2 else common}\t\nown line {i}\n" + (f"{rare}\n{rare}" if i < 3 else "") for i in range(1, 8)}
    rows = [(i, t) for i, t in texts.items()] + [(None, common), (9, None), (2, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs, bits=bits).collect()}
    assert [got[i]._n_dropped for i in range(1, 8)] == [1] * 6 + [0]
    assert got[1]._kept == texts[1].split("\n", 1)[1] and got[7]._kept == texts[7]
    assert got[None]._n_dropped == 0 and (got[9]._kept, got[9]._n_lines) == ("", 1)
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def _slow_tiles(p, t, least):
    used_p, used_t, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and i + k not in used_p and j + k not in used_t:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return total
        k, i, j = best[0], -best[1], -best[2]
        used_p |= set(range(i, i + k))
        used_t |= set(range(j, j + k))
        total += k


def test_tiles_do_not_overlap_and_cover_like_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        p = [rng.randrange(4) for _ in range(rng.randint(0, 30))]
        t = [rng.randrange(4) for _ in range(rng.randint(0, 30))]
        found = decontaminate.tiles(p, t, 3)
        for side in (0, 1):
            places = [x for f in found for x in range(f[side], f[side] + f[2])]
            assert len(places) == len(set(places))
        assert all(p[a : a + n] == t[b : b + n] for a, b, n in found)
        assert abs(sum(f[2] for f in found) - _slow_tiles(p, t, 3)) <= 6  # ties may be broken otherwise


def test_reordered_passages_are_found(spark, odd):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(7, " ".join(words)), (8, None)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, " ".join(words[20:] + ["x"] + words[:20])), (2, " ".join(words[:8])), (3, None), (4, "nothing " * 50)], "doc_id long, text string"
    )
    for block in (1, 10_000):
        got = decontaminate.overlaps(docs, bench, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id, r.covered) for r in got} == {(1, 7, 40), (2, 7, 8)}
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()} == {2, 3, 4}
    assert decontaminate.remove_contaminated(odd, bench).count() == 8


def test_links_equal_brute_force(spark, odd):
    rng = random.Random(1)
    base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(120)]
    texts = []
    for i in range(60):
        w = list(base) if i < 40 else [str(rng.randrange(999)) for _ in range(50)]
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(9))
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    links = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    block, ngram_join.BLOCK = ngram_join.BLOCK, 7
    try:
        got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs).collect()}
    finally:
        ngram_join.BLOCK = block
    assert [got[i] for i in range(60)] == links
    rows = ngram_join.near_duplicates(odd).collect()
    assert len(rows) == 8 and {r.class_id for r in rows if r.doc_id in (4, 6)} == {4}
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://x", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (None, "u", "<p>é</p>"), (9, "v", "y" * 99999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    folder = f"file://{tmp_path}/archives"
    index = warc.write_archives(pages, folder)
    got = {r.page_id: r for r in warc.read_records(index, folder).collect()}
    assert len(got) == 6
    for page, _, html in rows:
        assert got[page].payload_bytes == len((html or "").encode())
        assert got[page].payload_digest == warc.payload_digest((html or "").encode())
    assert {p: r.refers_to for p, r in got.items()} == {1: None, 2: None, 3: 1, 5: 2, None: 1, 9: None}
    assert warc.read_records(index.filter("page_id = 9"), folder).first().payload == b"y" * 99999
    assert warc.ranges([(0, 5), (5, 5), (100_000, 1)]) == [(0, 10), (100_000, 100_001)]


def test_windows_keep_every_turn_once(spark):
    rng = random.Random(2)
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant", None)[rng.randrange(3)]
            rows.append((c, t, role, None if rng.random() < 0.1 else " ".join(rng.choice(["<|im_end|>\n", "<\\|", "word", "|", "é"]) for _ in range(rng.randrange(30)))))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(turns, budget=120, history=30).cache()
    got = {r.conv_id: r for r in chat.conversation_digests(made).collect()}
    for c in range(12):
        own = [r for r in rows if r[0] == c]
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert made.count() > 24 and made.filter("n_repeated > 0").count() > 0
    none = spark.createDataFrame([], turns.schema)
    assert chat.windows(none).count() == 0


def test_fingerprints_equal_brute_force(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(rows)
    piece = re.compile(fingerprints.PIECE)
    for r in fingerprints.fingerprints(docs).collect():
        text = rows[r.doc_id]
        follow = rows[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(piece.findall(t)) for t in (text, edited, follow))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert r.near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
    assert fingerprints.fingerprints(odd).count() == 8
    assert fingerprints.fingerprints(empty(spark)).count() == 0


def test_marginals_meet_their_targets(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    goal = spark.createDataFrame([("en", 0.25), ("de", 0.25), ("fr", 0.5), ("xx", 9.0)], "value string, share double")
    rows = mixing.described(docs.filter("lang <> 'es'"))
    cells = rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("_cell_tokens"))
    raked = mixing.rake(cells, {"lang": goal, "source": mixing.tempered(cells, "source", 0.5)})
    sums = {r._lang: r.s for r in raked.groupBy("_lang").agg(F.sum("_weight").alias("s")).collect()}
    assert sums == pytest.approx({"en": 0.25, "de": 0.25, "fr": 0.5}, rel=1e-6)
    assert mixing.mix(odd).columns[: len(odd.columns)] == odd.columns
    assert mixing.mix(empty(spark)).count() == 0
    assert Counter(r.doc_id for r in mixing.mix(odd).collect())[1] == 0


def test_sample_has_the_raked_marginals_with_a_hot_and_a_rare_source(spark):
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        source = "rare" if i % 300 == 0 else "hot" if i % 10 else "other"
        text = " ".join(["word"] * rng.randint(20, 60)) + (" Licensed under" if i % 50 == 7 else "")
        rows.append((i, text, rng.choice(("en", "en", "de")), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wanted = spark.createDataFrame([("rare", 0.1), ("other", 0.3), ("hot", 0.6)], "value string, share double")
    sample = mixing.mix(docs, {"source": wanted})
    assert sample.filter("_copies < 1").count() == 0 and sample.filter("_copies > 1").count() > 0
    cells = mixing.described(docs).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("_cell_tokens"))
    whole = cells.agg(F.sum("_cell_tokens")).first()[0]
    written = mixing.repeated(sample)
    assert written.count() == sample.agg(F.sum("_copies")).first()[0]
    for d in mixing.DIMENSIONS:
        goals = wanted if d == "source" else mixing.tempered(cells, d, mixing.TEMPER)
        goal = {r.value: r.share for r in goals.collect()}
        got = {r[0]: r.n for r in written.groupBy(f"_{d}").agg(F.sum("_tokens").alias("n")).collect()}
        want = {v: mixing.FRACTION * whole * s / sum(goal.values()) for v, s in goal.items()}
        assert got == pytest.approx(want, rel=0.06)


def test_a_block_holds_a_repeated_test_once(spark, monkeypatch):
    held = []

    def watched(docs, block, seed, run=decontaminate._pass):
        held.append(block.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0])
        return run(docs, block, seed)

    monkeypatch.setattr(decontaminate, "_pass", watched)
    hot = " ".join(f"hot{i}" for i in range(20))
    rows = [(0, hot)] * 200 + [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(1, 41)] + [(None, hot), (7, None)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(1, hot), (2, rows[205][1]), (2, rows[205][1])], "doc_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench, block_bytes=1000).collect())
    assert got == {(1, 0): 200, (1, None): 1, (2, rows[205][0]): 2}
    assert len(held) > 1 and max(held) < 3000 and sum(held) == sum(len(t) for _, t in set(rows) if t)
    assert decontaminate.remove_contaminated(docs, bench).count() == 0


def test_slices_of_near_ids_and_of_a_repeated_id_stay_small(spark):
    rng = random.Random(8)
    ids = [*range(3000), *(rng.getrandbits(62) for _ in range(50)), *[7] * 1500]
    rows = [(d, f"text {i % 4000}") for i, d in enumerate(ids)] + [(-5, "same")] * 1500 + [(None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.with_next(docs).collect()
    sliced, guards = fingerprints.sliced(docs)
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert max(sizes) < 2 * len(rows) / 4 and guards.count() <= 2 + fingerprints.SLICES * 4
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    known = [r for r in rows if r[0] is not None]
    first, last = min(known)[1], max(known)
    assert Counter(r.following for r in got) == Counter([t for d, t in known] + [""])
    assert [r.following for r in got if (r.doc_id, r.text) == last] == [first]
    assert sum(r.following == "same" for r in got if r.doc_id == -5) == 1499


def test_sketches_alone_recover_any_difference(spark):
    rng = random.Random(9)
    alike = [(i << 20) | 5 for i in range(1, 40)]  # equal in the bits 0-8 and 40-47
    many = [rng.getrandbits(63) for _ in range(2000)]
    rows = [(alike, []), (alike[:20], alike[10:]), (many[:1200], many[200:]), ([], []), (many[:300], many[:300])]
    frame = spark.createDataFrame(rows, "l array<long>, r array<long>").select("*", F.expr(fingerprints.sketched("l", "r")).alias("d"))
    for r in frame.collect():
        assert r.d is not None and sorted(r.d) == sorted(set(r.l) ^ set(r.r))
