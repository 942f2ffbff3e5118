import random

import numpy as np
from pyspark.sql import functions as F

from tidewrack.llm import variants
from tidewrack.llm.mixing import mix_sources, reached_shares, token_counts
from tidewrack.llm.variants import similar_pairs
from tidewrack.llm.words import words_of


def test_pairs_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for family in range(30):
        base = r.choices(vocabulary, k=r.randint(50, 160))
        for _ in range(r.randint(1, 4)):
            w = base[:]
            for _ in range(r.randint(0, len(w) // 8)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((n, r.choice([None, "a title here", "", "other"]), " ".join(w)))
            n += 1
    rows += [(n, "t", rows[0][2]), (n + 1, "t", rows[0][2]), (n + 2, None, None), (n + 3, "x", ""), (n + 4, None, "short text"), (n + 5, None, "long " * 30000)]
    df = spark.createDataFrame(rows, "item_id bigint, title string, text string").withColumn("rep", F.lit("clash")).withColumn("n", F.lit(1))
    sets = {}
    for i, title, text in rows:
        if len(words_of(text)) >= 50:
            w = words_of(title) + words_of(text)
            sets[i] = set(zip(w, w[1:], w[2:]))
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    got = [tuple(x) for x in similar_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) <= want and len(want - set(got)) <= 0.002 * len(want)
    assert similar_pairs(df.limit(0)).count() == 0


def test_large_classes_are_paired_in_blocks(spark, monkeypatch):
    """All pairs within and across classes of more members than a block, each once; ids that repeat are in one class."""
    monkeypatch.setattr(variants, "BLOCK", 4)
    r = random.Random(9)
    base = [f"w{k}" for k in r.choices(range(400), k=120)]
    other = base[:60] + [f"v{k}" for k in range(8)] + base[64:]
    rows = [(k, None, " ".join(base)) for k in range(23)] + [(k, "x", " ".join(other)) for k in range(50, 61)] + [(90, None, " ".join(f"u{k}" for k in range(80))), (3, None, " ".join(f"z{k}" for k in range(80)))]
    got = [tuple(x) for x in similar_pairs(spark.createDataFrame(rows, "item_id bigint, title string, text string")).collect()]
    ids = [*range(23), *range(50, 61)]
    want = {(a, b) for a in ids for b in ids if a < b}
    assert len(got) == len(set(got)) and {p for p in got if 3 not in p} == {p for p in want if 3 not in p} and set(got) <= want


def _docs(spark, sizes):
    rows = [(k * 1000 + i, f"s{k}", " ".join(["word"] * (5 + i % 7))) for k, n in enumerate(sizes) for i in range(n)]
    rows += [(99990, None, "no source"), (99991, "s0", None), (99992, "s0", ""), (99993, "unknown", "text")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def test_shares_are_met_within_caps(spark):
    docs = _docs(spark, [600, 200, 60])
    targets = spark.createDataFrame([("s0", 0.5, 1), ("s1", 0.3, 2), ("s2", 0.2, 4), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, targets, slices=16)
    rows = mix.collect()
    assert len({(r.doc_id, r.pass_no) for r in rows}) == len(rows)
    got = {r.source: r for r in reached_shares(mix, docs, targets).collect()}
    for s in ("s0", "s1", "s2"):
        assert abs(got[s].actual_share - got[s].target_share) < 0.01 and got[s].most_uses <= got[s].max_repeats
    assert got["none"].tokens == 0
    # the least served source is used to its cap, nearly whole
    cap = {s: got[s].tokens / (docs.filter(F.col("source") == s).transform(lambda d: token_counts(d, "text")).agg(F.sum("tokens")).first()[0] * got[s].max_repeats) for s in ("s0", "s1", "s2")}
    assert max(cap.values()) > 0.97
    # documents come in order of finish time, and a prefix of the order keeps the shares
    half = sorted(rows, key=lambda r: r.finish)[: len(rows) // 2]
    total = sum(r.tokens for r in half)
    assert abs(sum(r.tokens for r in half if r.source == "s0") / total - 0.5) < 0.02


def test_budget_and_empty(spark):
    docs = _docs(spark, [300, 300])
    targets = spark.createDataFrame([("s0", 1.0, 1), ("s1", 3.0, 1)], "source string, target_share double, max_repeats int")
    rows = mix_sources(docs, targets, budget=1000, slices=8).collect()
    total = sum(r.tokens for r in rows)
    assert 980 <= total <= 1000 and abs(sum(r.tokens for r in rows if r.source == "s1") / total - 0.75) < 0.05
    assert mix_sources(docs.limit(0), targets).count() == 0
    assert mix_sources(docs, targets.limit(0)).count() == 0


def test_budget_is_spent_when_large_shares_are_used_up(spark):
    """The cut is the one of brute force, with nine tenths of the share used up early, and with more budget than tokens."""
    docs = _docs(spark, [10, 900, 3])
    targets = spark.createDataFrame([("s0", 0.9, 1), ("s1", 0.099, 1), ("s2", 0.001, 2)], "source string, target_share double, max_repeats int")
    every = sorted(mix_sources(docs, targets, budget=10**9, slices=8).collect(), key=lambda r: (r.finish, r.source, r.doc_id, r.pass_no))
    total = sum(r.tokens for r in every)
    assert len(every) == 10 + 900 + 6
    for budget in (60, 1000, 5000, total - 1, total, total + 1):
        want, spent = set(), 0
        for r in every:
            spent += r.tokens
            if spent > budget:
                break
            want.add((r.doc_id, r.pass_no))
        rows = mix_sources(docs, targets, budget=budget, slices=8).collect()
        assert {(r.doc_id, r.pass_no) for r in rows} == want and len(rows) == len(want), budget


def test_cut_is_found_level_by_level(spark, monkeypatch):
    """The same documents, whether the part of time that passes the budget is ordered as a whole or cut again and again."""
    from tidewrack.llm import mixing

    docs = _docs(spark, [700, 300, 80])
    targets = spark.createDataFrame([("s0", 0.6, 1), ("s1", 0.3, 1), ("s2", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = []
    for ticks, edge in ((4096, 20_000), (3, 1), (4, 50)):
        monkeypatch.setattr(mixing, "TICKS", ticks)
        monkeypatch.setattr(mixing, "EDGE", edge)
        rows = mix_sources(docs, targets, budget=2500).collect()
        assert 2500 - 12 < sum(r.tokens for r in rows) <= 2500
        got.append({(r.doc_id, r.pass_no) for r in rows})
    assert got[0] == got[1] == got[2]


def _packed_keys(spark, n, parts):
    """Symbols of n records, and the rows of their keys of the first round."""
    symbols = np.random.default_rng(1).integers(0, 65536, (n, variants.SLOTS), dtype=np.uint16)
    ids = [int(k) for k in np.random.default_rng(2).permutation(n) * 17 - 2**40]
    sig = spark.createDataFrame([(i, x.tobytes()) for i, x in zip(ids, symbols)], "item_id bigint, symbols binary")
    return symbols, ids, variants._packed(sig, parts, 0)


def test_variant_keys_are_moved_in_few_bytes(spark):
    """Every key of every record arrives, in its part, at 8 bytes and not as a row of some 30."""
    symbols, ids, packed = _packed_keys(spark, 500, 5)
    rows = packed.collect()
    got = set()
    for r in rows:
        keys, recs = variants._unpacked(r.least, r.wide, r.packed)
        got |= set(zip([r.part] * len(keys), keys.tolist(), recs.tolist()))
    keys = variants.variant_keys(symbols, 0)
    bits = 8 * variants.KEY_BYTES
    assert got == {((k >> bits) % 5, k & (1 << bits) - 1, i) for i, ks in zip(ids, keys.tolist()) for k in ks}
    assert sum(len(r.packed) for r in rows) <= 8 * keys.size
    assert len({k for t in range(variants.ROUNDS) for k in variants.variant_keys(symbols[:1], t)[0].tolist()}) == variants.SLOTS


def test_pairs_that_meet_equal_brute_force(monkeypatch):
    """All pairs under each key, hot ones too, in batches that stay bounded."""
    monkeypatch.setattr(variants, "PAIRS_A_BATCH", 50)
    r = np.random.default_rng(3)
    keys, ids = np.r_[r.integers(0, 40, 200), np.full(60, 99)].astype(np.uint64), np.r_[r.integers(-50, 50, 200), np.arange(60) - 30]
    want = {(a, b) for k, a in zip(keys, ids) for m, b in zip(keys, ids) if k == m and a < b}
    batches = list(variants._meeting(keys, ids.astype(np.int64)))
    assert {(a, b) for x in batches for a, b in zip(x["a"], x["b"])} == want and max(map(len, batches)) <= 50 + 300
    assert not any(len(x) for x in variants._meeting(np.zeros(0, np.uint64), np.zeros(0, np.int64)))


def test_unlike_records_rarely_meet(spark):
    """Unlike records that meet, which grow with the square of the records, are fewer than one pair in 100 at similarity 0.07."""
    r, n = np.random.default_rng(4), 3000
    symbols = np.where(r.random((n, variants.SLOTS)) < 0.07**0.5, 7, r.integers(0, 65536, (n, variants.SLOTS))).astype(np.uint16)
    met = set()
    for turn in range(variants.ROUNDS):
        keys = variants.variant_keys(symbols, turn)
        for x in variants._meeting(keys.reshape(-1), np.repeat(np.arange(n), keys.shape[1])):
            met |= set(zip(x["a"].tolist(), x["b"].tolist()))
    assert len(met) < n * (n - 1) / 2 / 100
