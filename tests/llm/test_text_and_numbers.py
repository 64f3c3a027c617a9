"""Percentiles, packing, mixing and residue: guarantees, brute force and odd input."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from seriesloom.llm import mixing, packing, quantiles, residue
from seriesloom.llm.ranks import positions


def test_positions_are_exact_in_hot_groups(spark):
    rows = [("hot" if i % 3 else None, i, i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, w long")
    out = positions(df, ["g"], ["id"], 1, weight=df["w"], bits=4).collect()
    for g in ("hot", None):
        part = sorted((r for r in out if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in part] == list(range(len(part)))
        assert [r.before for r in part] == [0, *np.cumsum([r.w for r in part])[:-1].tolist()]


@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=50))
@settings(max_examples=100, deadline=None)
def test_compress_keeps_all_counts(values):
    codes = np.unique(np.array([abs(hash(v)) % (1 << quantiles.LEVELS) for v in values]), return_counts=True)
    g = np.zeros(len(codes[0]), np.int64)
    for limit in (0, 3, 100):
        out = quantiles.compress(g, np.zeros(len(g), np.int32), codes[0].astype(np.int64), codes[1], np.array([limit]))
        assert out[3].sum() == len(values) and (out[1] <= quantiles.LEVELS).all()


def test_percentiles_keep_the_rank_bound_after_merging(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.lognormal(3, 1, 20_000), -rng.lognormal(1, 2, 3000), np.zeros(500), np.full(2000, 7.5), [1e12, -1e-12]])
    rng.shuffle(values)
    rows = [("hot", int(i % 9), float(v)) for i, v in enumerate(values)] + [("few", 0, 1.0), ("few", 1, 2.0), ("few", 1, 3.0)] + [("none", 0, float("nan")), ("none", 0, None), ("hot", 0, float("inf")), (None, 0, 4.0)]
    df = spark.createDataFrame(rows, "uid string, day int, x double")
    k = 400
    daily = quantiles.sketch(df, ["uid", "day"], "x", k)
    got = quantiles.percentiles(quantiles.merge(daily, ["uid"]), ["uid"], [0.05, 0.25, 0.5, 0.75, 0.95, 0.99], k).collect()
    assert {r.uid for r in got} == {"hot", "few", None}
    s = np.sort(values)
    for r in got:
        if r.uid == "hot":
            assert r.n == len(values) and 0 < r.rank_error <= quantiles.LEVELS * len(values) / k
            want, tol = int(np.ceil(r.q * r.n)), abs(r.value) * 2e-5 + 1e-15
            lo, hi = np.searchsorted(s, r.value - tol), np.searchsorted(s, r.value + tol, side="right")
            assert lo - r.rank_error <= want <= hi + r.rank_error
        elif r.uid == "few":
            assert r.rank_error == 0 and r.value == pytest.approx([1.0, 2.0, 3.0][int(np.ceil(r.q * 3)) - 1], rel=2e-5)
    assert daily.groupBy("uid").count().count() == 3
    small = daily.where("uid = 'hot'").count()
    assert small < 9 * 12 * k
    assert quantiles.percentiles(quantiles.merge(quantiles.sketch(df.where("false"), ["uid", "day"], "x"), ["uid"]), ["uid"], [0.5]).count() == 0


@given(st.lists(st.integers(1, 60), max_size=80), st.sampled_from([60, 61, 97]))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_item_once_and_never_overfills(items, capacity):
    counts = {s: items.count(s) for s in set(items)}
    load, large = {}, {}
    used = {s: [] for s in counts}
    for size, first, n, start, per in packing.plan(counts, capacity):
        used[size] += range(first, first + n)
        for i in range(n):
            load[start + i // per] = load.get(start + i // per, 0) + size
            if 3 * size > capacity:
                large[start + i // per] = large.get(start + i // per, 0) + 1
    assert all(sorted(u) == list(range(counts[s])) for s, u in used.items())
    assert all(v <= capacity for v in load.values()) and all(v <= 2 for v in large.values())
    assert sorted(load) == list(range(len(load)))
    if items:
        assert len(load) <= 1.5 * -(-sum(items) // capacity) + 2


def test_pack_whole_table(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 5, 30, 30, 30, 99, 250])) for i in range(2000)] + [(9001, 0), (9002, None), (9003, 1234)]
    df = spark.createDataFrame(rows, "item long, tokens long")
    packs = spark.createDataFrame([("s", 100), ("w", 1000)], "pack_name string, capacity_tokens int")
    out = packing.pack(df, packs).collect()
    for name, cap in (("s", 100), ("w", 1000)):
        load, per = {}, {}
        for r in out:
            if r.pack_name == name:
                load[r.container] = load.get(r.container, 0) + r.tokens
                per.setdefault(r.item, []).append(r.tokens)
        assert max(load.values()) <= cap
        assert {i: sum(per[i]) for i, _ in rows} == {i: t or 0 for i, t in rows}
        assert all(len(per[i]) == max(1, -(-(t or 0) // cap)) for i, t in rows)
        assert sum(load.values()) / (len(load) * cap) > 0.95
    assert packing.pack(df.where("false"), packs).count() == 0


def test_mix_reaches_shares_with_capped_repeats(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["big"] * 20 + ["mid"] * 3 + ["tiny"]), rng.choice([0, 10, 50, 200])) for i in range(6000)] + [(90001, None, 5), (90002, "other", 5)]
    df = spark.createDataFrame(rows, "item long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 4), ("tiny", 0.15, 2), ("gone", 0.05, 3)], "source string, target_share double, max_repeats int")
    out = mixing.mix(df, targets).collect()
    total = sum(r[2] for r in rows)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    assert set(by) == {"big", "mid", "tiny"}
    got = {s: sum(r.tokens for r in v) for s, v in by.items()}
    assert abs(got["big"] / total - 0.5) < 0.001 and abs(got["mid"] / total - 0.3) < 0.001
    assert got["tiny"] == 2 * sum(r[2] for r in rows if r[1] == "tiny")
    for s, most in (("big", 1), ("mid", 4), ("tiny", 2)):
        seen = [(r.item, r.copy_no) for r in by[s]]
        assert len(seen) == len(set(seen)) and max(c for _, c in seen) <= most
    assert sorted((r.shard, r.position) for r in out) == [(k, i) for k in sorted({r.shard for r in out}) for i in range(sum(x.shard == k for x in out))]
    rep = {r.source: r for r in mixing.shares(mixing.mix(df, targets), df, targets).collect()}
    assert rep["gone"].tokens_used == 0 and rep["tiny"].copies_most == 2 and rep["big"].reached_share == pytest.approx(got["big"] / total)
    assert mixing.mix(df.where("false"), targets).count() == 0


def test_quotas_are_exact():
    q = mixing.shard_quotas([1000, 37, 0, 3], 16, 1)
    assert q.sum(0).tolist() == [1000, 37, 0, 3] and set(q.sum(1).tolist()) <= {65}


RESIDUE = [
    "Speech by {{ speaker_name }} on the water charter.", "The vote on <%= title %> was opened.", "I call %MEMBER% to speak.", "séance du __PARTY__, point «Titre»", "[INSERT DATE HERE]", "[groupe à préciser] (TODO: date)", "I call <CONSTITUENCY>.", "Rede von &lt;redner_name&gt;",
    "Lorem ipsum dolor magna aliqua nisi culpa.", "Your text goes here.", "Mustertext Mustertext Mustertext.", "Votre texte ici.", "Su texto aquí.", "bla bla bla bla", "test test test 123 test",
    "HTTP Status 503 – Service Unavailable", "502 Bad Gateway Madame la présidente, je demande au ministre si le coût a augmenté.", "Error 404: Not Found", "Erreur 500 : page introuvable", "Zugriff verweigert (403)", "Su sesión ha caducado, vuelva a iniciar sesión.",
    "You need to enable JavaScript to run this app.", "Bitte aktivieren Sie JavaScript, um das Protokoll anzuzeigen.", "VEUILLEZ ACTIVER JS POUR AFFICHER LE COMPTE RENDU.", "Esta página requiere JavaScript.",
]
REAL = [
    '"Please enable JavaScript to continue", the portal told the miller; is that how we treat people?', "»Bitte aktivieren Sie JavaScript«, so begrüßt das Portal den Imker.", "Access denied: that is what the nurse hears at the counter in Lumrirst.", "The witness [name withheld at her request] spoke.", "The options {2, 3, 5} in the annex are withdrawn. [[p. 315]] {12}", "The costs rose by 404 percent.",
    "Ask anyone at __the__ quay: **we** will review it.", "<p>Your session has expired, Mr. Secretary, and so has your water charter.</p>", "Auf Seite neun stand noch Blindtext, wie die Verwaltung einräumte.", "Page nine of the draft still held a block of lorem ipsum, as the clerk admitted.", "Nul besoin de JavaScript pour lire un budget.", "La sÃ©ance est reprise.", "",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_seen(text):
    assert any(residue.spans(s) for s in residue.sentences(text))


@pytest.mark.parametrize("text", REAL)
def test_talk_and_markup_are_not(text):
    assert not any(residue.spans(s) for s in residue.sentences(text))


def test_fit_holds_every_window_of_every_document(spark):
    texts = [None, "", *[f"The {i}th speaker said a number of things about item {i % 7}, and went on for {i} minutes of the sitting. Then nothing more." for i in range(700)], "Error 404: Not Found", "Dear {{ name }}, welcome."]
    df = spark.createDataFrame([(t, f"h{i % 23}") for i, t in enumerate(texts)], "text string, host string")
    got = [residue.Packed(bytes(r.x)) for r in residue.packed(df, "text", "host").collect()]
    t = residue.Tokenized([r.text for r in df.where((residue.fold(F.col("host")) == 2) & F.col("text").isNotNull()).collect()])
    w = np.random.default_rng(3).normal(size=1 << residue.BITS)
    assert sum(len(p.label) for p in got) == len(t.a) and sum(p.label.sum() for p in got) == residue.labelled(t)[0].sum() > 0
    odds = np.sort(np.concatenate([p.scores(w) for p in got]))
    assert 1 / (1 + np.exp(-np.clip(odds, -30, 30))) == pytest.approx(np.sort(t.probability(w, 0.0)), abs=1e-9)
    d, sums = np.random.default_rng(4).normal(size=len(got[0].label)), np.zeros(1 << residue.BITS)
    got[0].add(d, sums)
    assert sums @ w == pytest.approx(d @ got[0].scores(w))


def test_classifier_finds_residue_in_unseen_hosts(spark):
    rng = random.Random(2)
    plain = ["The costs of the tram rose by {} percent.", "I thank the rapporteur, whose work helped the tenant in {}.", "Will the government review the bridge toll {}, yes or no?", "La séance est reprise à {} heures.", "Wir werden die Hafenabgabe {} kürzen."]
    rows, bad = [], set()
    for i in range(600):
        text = " ".join(rng.choice(plain).format(rng.randrange(900)) for _ in range(6))
        if i % 12 == 0:
            text = f"{text} {rng.choice(RESIDUE)}"
            bad.add(i)
        elif i % 12 == 1:
            text = f"{text} {rng.choice(REAL)}"
        rows.append((i, text, f"h{i % 40}", "x"))
    rows += [(1000, None, "h1", "x"), (1001, "", None, "x"), (1002, "word " * 40_000 + "Your text goes here.", "h2", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, kind string")
    got = {r.doc_id for r in residue.residue(df, "doc_id", "text", "host").collect()}
    assert got == bad | {1002}
    val = residue.validation(df, "doc_id", "text", "host").collect()
    assert sum(r.n_flagged for r in val if r.label == 1) >= 0.8 * sum(r.n_windows for r in val if r.label == 1)
    assert residue.residue(df.where("false"), "doc_id", "text", "host").count() == 0


def test_shard_runs_lie_side_by_side():
    blocks, shards = [1000, 37, 0, 3], 16
    first, size = mixing.shard_runs(blocks, shards, 1, np.arange(shards))
    assert (first == np.cumsum(size, axis=0) - size).all() and size.sum(0).tolist() == blocks
    one = mixing.shard_runs(blocks, shards, 1, np.array([11]))
    assert (one[0][0] == first[11]).all() and (one[1][0] == size[11]).all()


def test_extreme_doubles_have_codes_of_their_own(spark):
    values = [5e-324, 1e-300, 1e-30, 1.0, 1e30, 1.7e308]
    rows = [(v,) for v in values + [-v for v in values] + [0.0]]
    df = spark.createDataFrame(rows, "x double")
    got = sorted((r.x, r.c) for r in df.select("x", quantiles.code(df["x"]).alias("c")).collect())
    codes = np.array([c for _, c in got])
    assert (np.diff(codes) > 0).all() and codes.min() >= 0 and codes.max() < 1 << quantiles.LEVELS
    back = quantiles.decode(codes)
    assert all(abs(b - x) <= 2e-5 * abs(x) + 5e-324 for (x, _), b in zip(got, back, strict=True))
