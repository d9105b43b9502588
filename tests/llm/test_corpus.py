"""Operators over the whole corpus, and the pipeline, against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from helpers import clashing, documents, odd_rows, prose, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxmetric.llm import covering, crf, packing, queries, reputation, segments, sieve, substring, tallies

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def corpus(seed=0, n=60):
    """Prose, exact and near copies, shared passages and a passage twice in a text."""
    rng = random.Random(seed)
    shared = [prose(1000 + i, 50) for i in range(3)]
    rows = []
    for i in range(n):
        text = prose(seed * 7919 + i, rng.randint(20, 120))
        if i % 4 == 0:
            text += " " + shared[i % 3] + prose(i + 5, 20)
        if i % 15 == 3:
            text += " " + text
        if i % 5 == 4:
            text = rows[i - 3][1]
        if i % 6 == 5:
            words = rows[i - 1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        rows.append((i, text))
    return rows


# -------------------------------------------------------------- substring


def stripped_by_hand(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    times = collections.Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - length + 1):
            if times[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "seed_words"), [(35, 10), (12, 5), (4, 4)])
@pytest.mark.parametrize("block_bytes", [4 << 20, 3000])
def test_repeats_against_brute_force(spark, monkeypatch, length, seed_words, block_bytes):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block_bytes)
    rows = corpus() + odd_rows()
    df = documents(spark, rows).repartition(3)
    got = substring.strip_repeats(df, length, seed_words).withColumn("sha", F.sha2("text", 256))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "sha") == stripped_by_hand(rows, length)
    for r in got.collect():
        assert sum(x["to"] - x["from"] for x in r.repeats) == r.n_removed
        assert all(a["to"] < b["from"] for a, b in zip(r.repeats, r.repeats[1:]))


def test_repeats_keep_other_columns(spark):
    df = documents(spark, odd_rows()).withColumns({"a": F.lit(1), "first": F.lit("x"), "block": F.lit("y"), "n_words": F.lit("z")})
    got = substring.strip_repeats(df)
    assert got.columns == [c for c in df.columns if c != "n_words"] + ["n_words", "n_removed", "repeats"]
    assert {(r.a, r["first"], r.block) for r in got.collect()} == {(1, "x", "y")}
    assert substring.strip_repeats(df.limit(0)).count() == 0


# ---------------------------------------------------------- near-duplicates


def fingerprint_by_hand(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(rows):
    """component of every distinct (id, fingerprint), by search over all pairs."""
    nodes = sorted({(fp, i) for i, fp in rows}, key=repr)
    out = {}
    for node in nodes:
        if node in out:
            continue
        group, front = {node}, [node]
        while front:
            fp = front.pop()[0]
            near = [m for m in nodes if m not in group and (m[0] ^ fp).bit_count() <= 3]
            group.update(near)
            front += near
        name = min((i for _, i in group if i is not None), default=None)
        out.update(dict.fromkeys(group, name))
    return out


@pytest.mark.parametrize("bucket", [4096, 2])
def test_classes_against_brute_force(spark, bucket):
    rows = corpus(3, 80) + odd_rows()
    prints = [(i, fingerprint_by_hand(t)) for i, t in rows]
    want = components_by_hand(prints)
    got = covering.classes(clashing(documents(spark, rows)).repartition(3), bucket).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == sorted(
        ((i, fp, want[fp, i]) for i, fp in prints), key=repr
    )


def test_links_of_a_dense_ball(spark):
    """Fingerprints all around a few centres, in buckets that must be dealt on."""
    rng = random.Random(4)
    values = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            values.add(x)
    want = components_by_hand([(i, v) for i, v in enumerate(sorted(values))])
    df = spark.createDataFrame([(i, covering._signed(v)) for i, v in enumerate(sorted(values))], "name bigint, fp bigint")
    for bucket in (4096, 20, 1):
        found = covering.components(covering.links(df.select("fp"), bucket), df)
        got = {r.fp % (1 << 64): r.component for r in found.collect()}
        assert all(got.get(fp, i) == name for (fp, i), name in want.items())


def test_masks_cover_every_pair_within_the_radius():
    masks = covering.masks()
    assert len(masks) == 15 and all(32 <= m.bit_count() <= 35 for m in masks)
    rng = random.Random(1)
    for _ in range(3000):
        differing = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not differing & m for m in masks)
    for mask in masks:
        parts = covering._refined(mask)
        differing = sum(1 << b for b in rng.sample([i for i in range(64) if not mask >> i & 1], 3))
        assert any(not differing & m for m in parts)


def test_one_document_of_each_class_stays(spark):
    rows = corpus(5, 40) + odd_rows()
    df = documents(spark, rows)
    want = components_by_hand([(i, fingerprint_by_hand(t)) for i, t in rows])
    kept = covering.representatives(clashing(df))
    assert kept.columns == clashing(df).columns
    # Rows that share an id may name several classes: one row stays of each class.
    fps, names = sorted({fp for fp, _ in want}), []
    while fps:
        group = [fps.pop()]
        for fp in group:
            near = [x for x in fps if (x ^ fp).bit_count() <= 3]
            group += near
            fps = [x for x in fps if x not in near]
        names.append(min((i for fp, i in want if fp in group and i is not None), default=None))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(names, key=repr)
    assert covering.representatives(df.limit(0)).count() == 0 == covering.classes(df.limit(0)).count()


def test_rows_with_one_id_and_other_texts_lose_no_class(spark):
    a, b, c = prose(31, 60), prose(32, 60), prose(33, 60)
    rows = [(1, a), (1, b), (2, b), (1, c), (None, c), (1, a, "fr", "s", 1), (3, None), (3, ""), (None, prose(34, 60))]
    df = documents(spark, rows)
    want = components_by_hand([(i, fingerprint_by_hand(t)) for i, t, *_ in rows])
    assert len({fp for fp, _ in want}) == 5
    for order in (rows, rows[::-1]):
        kept = covering.representatives(documents(spark, order).repartition(3)).collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (1, b), (1, c), (3, ""), (0, rows[-1][1])])
        assert {r.lang for r in kept} == {"en"}
    assert covering.representatives(df.union(df)).count() == 5


# ----------------------------------------------------------------- packing


def pieces_by_hand(rows, capacity):
    encode = Tokenizer.from_file(WORD_BPE).encode
    out = []
    for i, text in rows:
        ids = [*encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            out.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def gapless(rows, capacity):
    """The number of sequences, each filled from 0 without a gap."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing_against_brute_force(spark, capacity):
    rows = corpus(9, 50) + odd_rows() + [(70, "<|endoftext|>x. İ% İ. É, ÀB' it's 'LL"), (71, "e\u0301. \u0301a")]
    got = packing.pack(clashing(documents(spark, rows)).repartition(4), WORD_BPE, capacity)
    assert rows_of(got, "doc_id", "piece", "start", "length", "ids_crc32") == pieces_by_hand(rows, capacity)
    placed = got.collect()
    used = gapless(placed, capacity)
    assert used <= -(-sum(r.length for r in placed) // capacity) + 2


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, []), WORD_BPE).count() == 0


def sequences(plan, histogram):
    """Sequences of a plan; every rank of every length has exactly one place."""
    fill = collections.Counter()
    for n in np.flatnonzero(histogram):
        mine = plan[plan[:, 0] == n]
        assert mine[0, 1] == 0
        ends = np.append(mine[1:, 1], histogram[n])
        for (_, first, sequence, _), end in zip(mine, ends):
            fill.update({sequence + i: int(n) for i in range(end - first)})
    assert max(fill.values()) < len(histogram)
    return len(fill)


def best_fit(histogram):
    free, used = collections.Counter(), 0
    for n in range(len(histogram) - 1, 0, -1):
        for _ in range(histogram[n]):
            room = min((f for f, k in free.items() if f >= n and k), default=None)
            if room is None:
                used, room = used + 1, len(histogram) - 1
            else:
                free[room] -= 1
            free[room - n] += 1
    return used


@pytest.mark.parametrize(("low", "high"), [(1, 129), (40, 60), (30, 45), (64, 66), (128, 129), (43, 44)])
def test_plan_is_no_worse_than_best_fit(low, high):
    rng = np.random.default_rng(low)
    histogram = np.bincount(rng.integers(low, high, 3000), minlength=129)
    plan = packing.plan(histogram, step=1)
    lower = -(-int((np.arange(129) * histogram).sum()) // 128)
    assert lower <= sequences(plan, histogram) <= best_fit(histogram) + 3


def test_plan_of_short_lengths_is_near_the_bound():
    """Lengths of which every one is at most a quarter of the capacity are in the LP too."""
    rng = np.random.default_rng(1)
    for lengths, most in (
        ([992] * 3000 + [544] * 2000, 1001),
        (rng.integers(600, 1025, 20_000), 4050),
        (rng.choice([700, 850, 990], 20_000, p=[0.3, 0.3, 0.4]), 4380),
    ):
        histogram = np.bincount(lengths, minlength=4097)
        assert sequences(packing.plan(histogram), histogram) <= most


def test_pricing_is_the_best_knapsack():
    rng = np.random.default_rng(2)
    prices = np.append(0, rng.random(12)) * (np.arange(13) % 3 != 0)
    config = packing._best(prices)
    best = max(a * prices[s] + b * prices[t] + c * prices[u] for s in range(13) for t in range(13) for u in range(13)
               for a in range(13) for b in range(3) for c in range(2) if a * s + b * t + c * u <= 12 and s and t and u)
    assert (config * np.arange(13)).sum() <= 12 and (config * prices).sum() >= best - 1e-12


# ------------------------------------------------------------------- top-k


def top_by_hand(rows, k):
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % 50 == 0}):
        a = next(v for i, v in usable if i == q)
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in usable if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 2])
def test_top_k_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(segments, "BLOCK", block)
    monkeypatch.setattr(segments, "SHARD", 60 * block)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(size=20).astype("f4")]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [(301, rows[9][1])]
    rows += [(400, None), (450, [1.0, None]), (500, [float("nan")] * 20), (550, [float("inf")] * 20), (None, rows[3][1]), (600, [0.5, -0.25]), (650, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    df = df.withColumns({c: F.lit("clash") for c in ("block", "shard", "v", "rank", "score", "label")})
    got = segments.top_k(df, F.col("vec_id") % 50 == 0)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(top_by_hand(rows, 5), key=repr)


def test_top_k_of_large_and_few_vectors(spark):
    rows = [(0, [2e38, -3e38]), (1, [3e38, 1.0]), (2, [-3e38, 2.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = rows_of(segments.top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score")
    assert [(q, i) for q, _, i, _ in got] == [(0, 1), (0, 50), (0, 2), (50, 1), (50, 0), (50, 2)]
    assert got[0][3] == 2**63 - 1
    assert segments.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --------------------------------------------------------------- reputation


def test_urls_by_rule_and_reputation(spark):
    urls = [
        "http://A.Example.net/en/x?y#z", "https://example.net/de/1", "x://example.com/de/", "http://example.com/de", "http://q.org/fr/#a",
        "http://q.org/en", "http://net", "http://net/", "http://xnet/", None, "no scheme", "://h", "http://b.test?u=http://c.net/",
        "http://bad.test/1", "http://bad.test/2", "", "http://a.net/\nx",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://net/")], "page_id bigint, url string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("host", "bad", "path", "rule", "mean")})
    bad = [(i, True) for i in (13, 14) for _ in range(40)] + [(4, False)] * 40 + [(5, None), (99, True), (None, True)]
    outcomes = spark.createDataFrame(bad, "page_id bigint, bad boolean")
    got = {r.page_id: r for r in reputation.judge(pages, outcomes).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert [got[i].rule for i in range(1, 9)] == ["net/", "example.com/de/", None, "org/fr/", None, None, "net/", None]
    assert [(got[i].host, got[i].path) for i in (9, 10, 11, 12, 15, 16)] == [("", ""), ("", ""), ("h", ""), ("b.test", ""), ("", ""), ("a.net", "/\nx")]
    assert got[13].verdict == got[14].verdict == "block" and got[5].verdict == "allow"
    assert got[13].posterior_bound > 0.5 > got[5].posterior_bound
    # A host without labels is judged by its suffix: those of .test are all bad.
    assert got[12].posterior_mean > got[5].posterior_mean
    assert len(got) == 18
    none = reputation.judge(pages, outcomes.limit(0))
    assert {r.verdict for r in none.filter("rule is null").collect()} == {"allow"}
    assert reputation.judge(pages.limit(0), outcomes).count() == 0


def test_posteriors_shrink_to_the_parent(spark):
    rows = [(f"h{i}.d{i % 3}.s", j < 2) for i in range(30) for j in range(10)]
    hosts, domains, suffixes, everything = reputation.posteriors(spark.createDataFrame(rows, "host string, bad boolean"))
    assert hosts.count() == 30 and domains.count() == 3 and suffixes.count() == 1
    m = everything.collect()[0]["mean"]
    assert m == pytest.approx(61 / 302)
    # All rates are equal, so the prior is as strong as it can be.
    assert all(abs(r["mean"] - 0.2) < 0.01 and r["bound"] < r["mean"] for r in hosts.collect())


# ------------------------------------------------------------------ tallies

EVENT = "op string, seq int, doc_id bigint, source string, lang string, version string, n_tokens bigint, n_chars bigint"


def test_tallies_follow_every_batch(spark, tmp_path):
    rng = random.Random(3)
    kept = tallies.Tallies(spark, str(tmp_path / "t"))
    state = {}
    for batch in range(1, 5):
        events = []
        for seq in range(40):
            doc = rng.randrange(25)
            op = rng.choice(["insert", "revise", "delete"])
            row = (rng.choice(["s", None]), rng.choice("xy"), f"v{batch % 2}", rng.randrange(9), rng.randrange(99))
            events.append((op, seq, doc, *row))
        kept.commit(batch, spark.createDataFrame(events, EVENT).withColumn("sign", F.lit("clash")))
        if batch == 2:
            kept.commit(batch, spark.createDataFrame(events, EVENT))
        for op, _, doc, *row in sorted(events, key=lambda e: e[1]):
            state.pop(doc, None)
            if op != "delete":
                state[doc] = row
        want = collections.defaultdict(lambda: [0, 0, 0])
        for *key, tokens, chars in state.values():
            t = want[tuple(key)]
            t[0], t[1], t[2] = t[0] + 1, t[1] + tokens, t[2] + chars
        got = {tuple(r)[:3]: list(r)[3:] for r in kept.totals().collect()}
        assert got == want
        if batch == 3:
            kept.compact()
            kept.compact()
            kept.vacuum()
            assert {tuple(r)[:3]: list(r)[3:] for r in kept.totals().collect()} == want
            assert kept._listed("rows") == [] and kept._listed("base") == [3]
    assert sorted(r.doc_id for r in kept.current().collect()) == sorted(state)
    assert kept._listed("rows") == [4] and kept._listed("events") == []
    kept.commit(2, spark.createDataFrame([("insert", 0, 99, "s", "x", "v", 5, 9)], EVENT))
    assert 99 not in {r.doc_id for r in kept.current().collect()}
    with pytest.raises(ValueError):
        kept.commit(0, spark.createDataFrame([], EVENT))


def test_a_commit_reads_the_buckets_it_touches(spark, tmp_path, monkeypatch):
    kept = tallies.Tallies(spark, str(tmp_path / "t"), buckets=8)
    kept.commit(1, spark.createDataFrame([("insert", 0, i, "s", "x", "v", i, 1) for i in range(200)], EVENT))
    assert kept._listed("rows/batch=1") == list(range(8))
    read, current = [], tallies.Tallies.current

    def seen(self, batches=None, buckets=None):
        found = current(self, batches, buckets)
        read.append({r[0] for r in found.select("bucket").distinct().collect()})
        assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString() or len(buckets) != 1
        return found

    monkeypatch.setattr(tallies.Tallies, "current", seen)
    # The number of buckets of the first batch holds.
    again = tallies.Tallies(spark, str(tmp_path / "t"), buckets=3)
    again.commit(2, spark.createDataFrame([("revise", 0, 7, "s", "x", "v", 100, 1)], EVENT))
    assert len(read) == 1 and len(read[0]) == 1
    assert [tuple(r) for r in again.totals().collect()] == [("s", "x", "v", 200, sum(range(200)) + 93, 200)]
    # A base that was begun and has no marker is not read.
    monkeypatch.setattr(tallies.Tallies, "current", current)
    again._write("base", 2, again.current().limit(3).withColumn("sign", F.lit(1)))
    assert again.current().count() == 200
    again.compact()
    assert again.current().count() == 200 and again._listed("compacted") == [2]


def test_token_counts_are_those_of_the_tokenizers(spark):
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    rows = documents(spark, [*odd_rows(), (13, "Tier " * 4000 + "x" * 5000), (14, "<|endoftext|> Ünder\u00a0the")])
    got = clashing(rows).select("text", tallies.token_count("text", WORD_BPE), tallies.token_count("text", pieces)).collect()
    words, model = Tokenizer.from_file(WORD_BPE), sentencepiece.SentencePieceProcessor(model_file=pieces)
    assert len(got) == rows.count()
    for text, n_words, n_pieces in got:
        assert n_words == len(words.encode(text or "", add_special_tokens=False).ids)
        assert n_pieces == len(model.encode(text or ""))
    assert rows.limit(0).select(tallies.token_count("text", pieces)).count() == 0


def test_query_of_tallies_against_a_plain_count(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, None if i == 7 else prose(i, rng.randint(0, 40)), rng.choice(["en", "de", None]), rng.choice("ab")) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, rng.randrange(2), int(rng.random() < 0.2)) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    words, model = Tokenizer.from_file(WORD_BPE), sentencepiece.SentencePieceProcessor(model_file=pieces)
    judged = {i: rest for i, *rest in labels}
    want = collections.defaultdict(lambda: [0, 0, 0])
    for i, text, lang, source in rows:
        quality, toxic = judged.get(i, (1, 0))
        if toxic:
            continue
        bad, text = quality == 0, text or ""
        n = len(model.encode(text)) if bad else len(words.encode(text, add_special_tokens=False).ids)
        t = want[source, lang, "piece_bpe_32k" if bad else "word_bpe_49k"]
        t[0], t[1], t[2] = t[0] + 1, t[1] + n, t[2] + len(text)
    got = {tuple(r)[:3]: list(r)[3:] for r in queries.op3_token_tallies(spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 8


def test_a_sieve_loses_no_id(spark):
    ids = spark.range(0, 60_000, 20).withColumn("id", F.when(F.col("id") != 40, -F.col("id")))
    rows = spark.range(-60_000, 60_000)
    for max_bits in (1 << 26, 1 << 10):
        passed = {r[0] for r in rows.filter(sieve.sieve(ids, "id", max_bits)("id")).collect()}
        assert {-i for i in range(0, 60_000, 20) if i != 40} <= passed
        assert len(passed) < 15_000 or max_bits == 1 << 10
    assert rows.limit(1000).filter(sieve.sieve(ids.limit(0), "id")("id")).count() == 0
    nulls = spark.createDataFrame([(None,)], "id bigint")
    assert nulls.filter(sieve.sieve(ids, "id")("id")).count() == 1


def test_texts_are_counted_before_the_join(spark, tmp_path, monkeypatch):
    documents(spark, odd_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, commit = [], tallies.Tallies.commit

    def keep(self, batch, events):
        seen.append(events._jdf.queryExecution().optimizedPlan().toString())
        commit(self, batch, events)

    monkeypatch.setattr(tallies.Tallies, "commit", keep)
    assert queries.op3_token_tallies(spark, str(tmp_path)).count() > 0
    join, _, below = seen[1].partition("Join Inner")
    assert "text" not in join and "ArrowEvalPython" not in join and "ArrowEvalPython" in below


def test_a_failed_commit_is_not_seen(spark, tmp_path, monkeypatch):
    kept = tallies.Tallies(spark, str(tmp_path / "t"))
    first = spark.createDataFrame([("insert", 0, 1, "s", "x", "v", 5, 9), ("insert", None, None, "s", "x", "v", 5, 9)], EVENT)
    kept.commit(1, first)
    second = spark.createDataFrame([("delete", 0, 1, None, None, None, None, None), ("insert", 1, 2, "s", "x", "v", None, 3)], EVENT)
    write = tallies.Tallies._write

    def fails(self, kind, batch, df):
        if kind == "committed":
            raise RuntimeError
        write(self, kind, batch, df)

    monkeypatch.setattr(tallies.Tallies, "_write", fails)
    with pytest.raises(RuntimeError):
        kept.commit(2, second)
    assert [tuple(r) for r in kept.totals().collect()] == [("s", "x", "v", 1, 5, 9)]
    monkeypatch.setattr(tallies.Tallies, "_write", write)
    kept.commit(2, second)
    assert [tuple(r) for r in kept.totals().collect()] == [("s", "x", "v", 1, 0, 3)]
    kept.commit(3, spark.createDataFrame([], EVENT))
    assert kept.totals().count() == 1
    assert tallies.Tallies(spark, str(tmp_path / "none")).totals().count() == 0


# ----------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus(11, 60) + odd_rows() + [(90, "12 34 ## " * 30)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = before, docs
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["language_id"]
    model = crf.train(before.filter(~crf.held_out()))
    judged = crf.identify(before, model, ["doc_id", "text"]).collect()
    assert rows_of(after, "doc_id", "text") == sorted(((r.doc_id, r.text) for r in judged if r.lang_pred != "und" and r.score >= 0.4), key=repr)
    before, after = seen["near_dedup"]
    prints = [(r.doc_id, fingerprint_by_hand(r.text)) for r in before.collect()]
    names = components_by_hand(prints)
    assert sorted(i for (i,) in rows_of(after.filter("doc_id is not null"), "doc_id")) == sorted({n for n in names.values() if n is not None})
    before, after = seen["substring_dedup"]
    want = stripped_by_hand([(r.doc_id, r.text) for r in before.collect()], 35)
    got = rows_of(after.withColumn("sha", F.sha2("text", 256)), "doc_id", "sha")
    assert got == [(i, sha) for i, _, _, sha in want]
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["best_fit_packing"]
    assert rows_of(after, "doc_id", "piece", "start", "length", "ids_crc32") == pieces_by_hand([(r.doc_id, r.text) for r in before.collect()], 4096)
    gapless(after.collect(), 4096)
    assert rows_of(pipeline.run(spark, str(tmp_path)), "doc_id", "piece", "ids_crc32") == rows_of(after, "doc_id", "piece", "ids_crc32")
