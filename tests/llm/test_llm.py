"""Packing, mixing and text quality on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, prose, quality, tokens

PATH = f"{tokens.VOCABULARY_DIR}/{tokens.VOCABULARY}"


# Tokens


@pytest.mark.parametrize("text", ["", "Hello there, it's 10 o'clock.\n\nTwo   blanks", "ñandú " * 9000, "a" * 30000, "x y " * 20000, "1\t2\r\n" * 8000, "information|" * 100_000, "because," * 150_000, "_a b_" * 9000])
def test_counting_in_pieces_adds_up(text):
    assert "".join(tokens.pieces(text)) == text
    assert tokens.count_tokens(text, PATH) == len(tokens.encoding(PATH).encode_ordinary(text))


def test_token_columns(spark):
    df = spark.createDataFrame([(1, "Head line\nand the body follows"), (2, None), (3, ""), (4, "one line only")], "id long, text string")
    got = {r.id: (r.tokens, r.prompt) for r in tokens.with_token_counts(df, "text", "tokens", "prompt").collect()}
    assert got[2] == got[3] == (0, 0) and got[4][1] == 0 and 0 < got[1][1] < got[1][0]


# 8. Packing


def test_containers_keep_all_limits():
    rng = np.random.default_rng(3)
    demands = np.column_stack([rng.integers(1, 400, 700), np.ones(700), rng.integers(0, 300, 700)]).astype(float)
    demands[:, 2] = np.minimum(demands[:, 2], demands[:, 0])
    limits = np.array([512.0, 6.0, 380.0])
    where = packing.fill_containers(demands, limits)
    loads = np.zeros((where.max() + 1, 3))
    np.add.at(loads, where, demands)
    assert (loads <= limits + 1e-9).all()
    assert len(loads) <= 1.12 * np.ceil((demands.sum(axis=0) / limits).max())


def test_equal_items_fill_exactly():
    where = packing.fill_containers(np.tile([128.0, 1.0, 0.0], (40, 1)), np.array([512.0, 100.0, 512.0]))
    assert sorted(np.bincount(where)) == [4] * 10


def test_every_text_is_placed_once_and_split_only_beyond_the_capacity(spark):
    rng = random.Random(4)
    sizes = [rng.choice([1, 5, 64, 100, 300, 511, 512, 513, 5000]) for _ in range(400)] + [0, 0]
    df = spark.createDataFrame([(i, n, n // 10, "x") for i, n in enumerate(sizes)] + [(3, sizes[3], sizes[3] // 10, "x"), (900, None, None, "x")], "id long, tokens long, prompt long, container string")
    got = packing.pack_texts(df, {"s": 512, "m": 2048}, packing.Limits(16, 0.98)).collect()
    for pack, capacity in (("s", 512), ("m", 2048)):
        rows = [r for r in got if r.pack == pack]
        for i, n in enumerate(sizes):
            own = sorted(r.piece for r in rows if r.id == i)
            assert own == list(range(max(1, -(-n // capacity))))
            assert sum(r.tokens for r in rows if r.id == i) == n
        assert {r.id for r in rows if r.status == "empty"} == {400, 401, 900}
        loads = {}
        for r in rows:
            if r.container:
                load = loads.setdefault(r.container, [0, 0, 0])
                load[0] += r.tokens
                load[1] += 1
                load[2] += r.loss
        assert all(t <= capacity and s <= capacity // 16 and (loss <= capacity * 0.98 or s == 1) for t, s, loss in loads.values())
        assert sum(t for t, _, _ in loads.values()) / (len(loads) * capacity) > 0.9


def test_nothing_to_pack(spark):
    assert packing.pack_texts(spark.createDataFrame([], "id long, tokens long, prompt long"), {"s": 512}).collect() == []


# 9. Mixing


def texts(spark, counts, seed=1):
    rng = random.Random(seed)
    data, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            data.append((i, source, f"{source} {i}", rng.randint(5, 60)))
            i += 1
    return spark.createDataFrame(data + [(i, "a", "a 0", 5), (i + 1, "unlisted", "u", 5), (i + 2, "a", None, 0), (i + 3, None, "q", 7)], "id long, source string, hash string, tokens long")


def test_shares_and_caps(spark):
    targets = {"a": (0.5, 1), "b": (0.3, 3), "c": (0.15, 5), "none": (0.05, 4)}
    mix = mixing.mix_sources(texts(spark, {"a": 900, "b": 300, "c": 20}), targets)
    report = {r.source: r for r in mixing.share_report(mix).collect()}
    assert report["none"].note == "no text" and report["none"].tokens_used == 0
    for s, (share, cap) in targets.items():
        if s != "none":
            assert report[s].actual_share == pytest.approx(share / 0.95, abs=0.01)
            assert report[s].most_repeats <= cap
    placed = mix.placed.collect()
    assert max(r.copy for r in placed if r.source == "c") == 5
    assert len({(r.id, r.copy) for r in placed}) == len(placed) and all(0 <= r.position <= 1 for r in placed)
    assert not {r.source for r in placed} - set(targets)


def test_the_note_tells_a_shortfall(spark):
    rows = [(i, "a", f"a {i}", 10) for i in range(1000)] + [(2000, "long", "long text", 5000), (2001, "coarse", "coarse one", 60), (2002, "coarse", "coarse two", 700), (2003, "zero", "z", 10), (2004, "capped", "c", 10)]
    df = spark.createDataFrame(rows, "id long, source string, hash string, tokens long")
    mix = mixing.mix_sources(df, {"a": (0.8, 1), "long": (0.1, 1), "coarse": (0.1, 1), "zero": (0.0, 1), "capped": (0.1, 0), "none": (0.1, 1)}, total=5000)
    report = {r.source: r for r in mixing.share_report(mix).collect()}
    assert {s: r.note for s, r in report.items()} == {"a": "met", "long": "not used", "coarse": "short", "zero": "not used", "capped": "not used", "none": "no text"}
    assert report["long"].tokens_wanted > 0 and report["coarse"].tokens_used == 60


def test_a_text_in_two_sources_is_used_by_one(spark):
    df = spark.createDataFrame([(1, "a", "same", 10), (2, "b", "same", 10), (3, "a", "same", 10), (4, "a", "other", 30), (5, "b", "third", 5)], "id long, source string, hash string, tokens long")
    got = sorted((r.id, r.source, r.copies) for r in mixing.distinct_texts(df, {"a": (0.5, 1), "b": (0.5, 1)}).collect())
    assert got == [(2, "b", 3), (4, "a", 1), (5, "b", 1)]


def test_schedule_follows_the_slope(spark):
    mix = mixing.mix_sources(texts(spark, {"a": 2000, "b": 2000}), {"a": (0.5, 1), "b": (0.5, 1)}, tilt=0.8)
    early = mix.placed.filter("position < 0.25").groupBy("source").agg(F.sum("tokens").alias("n"))
    share = {r.source: r.n for r in early.collect()}
    slope = {s.source: s.slope for s in mix.shares}
    for s in "ab":
        assert share[s] / sum(share.values()) == pytest.approx(0.5 * (1 + slope[s] * 0.75), abs=0.03)


def test_plan_never_exceeds_supply():
    for s in mixing.plan_shares({"a": (1000, 10, 100.0), "b": (17, 2, 8.5)}, {"a": (0.9, 2), "b": (0.1, 3), "c": (None, None)}, 0.6, 10**9):
        assert s.demand <= s.supply * s.max_repeats and s.passes <= s.max_repeats and 0 <= s.rest


def test_mixing_nothing(spark):
    mix = mixing.mix_sources(texts(spark, {}).filter("source = 'zzz'"), {"a": (1.0, 2)})
    assert mix.placed.collect() == [] and [r.tokens_used for r in mixing.share_report(mix).collect()] == [0]


# 10. Quality

PROSE = "The clinic said on Monday that it will stay open until nine. Nobody knows when the wave will end, but the numbers are falling."
CASES = {
    PROSE: False,
    PROSE.upper(): False,
    "> " + PROSE: False,
    "\n".join(PROSE[i : i + 45] for i in range(0, len(PROSE), 45)): False,
    "La clínica dijo que el número de pacientes subió por segunda semana seguida.\r\nLos vecinos preguntan por qué no hay medicinas.": False,
    "fips,county,visits\n" + "03001,Torwick County,31\n" * 20: True,
    PROSE + "\n" + "| 03001 | Torwick | 31 |\n" * 30: True,
    PROSE * 4 + "\n" + "- Torwick: 31%\n" * 3: False,
    "\n".join(["Home", "Sports", "Sign in", "More", "Live TV"] * 9): True,
    "• Flu visits dip after the holidays in Dormore\n" * 8: True,
    "lllffifaagggyyyhhhdddyyffyykkkjgeeguiii" * 9: True,
    "/@@>_ &/%_<<< _< =#>@<&&>|$<" * 9: True,
    "": True,
    "\t\r\n": True,
    "12 34 56": True,
}


def test_prose_share():
    for text, junk in CASES.items():
        assert (not prose.words_of(text) or prose.prose_share(text) < 0.5) == junk, text[:60]


def exact(text):
    return not prose.words_of(text or "") or prose.prose_share(text or "") < 0.5


def ordinary(k):
    return PROSE + f" It was day {k}, and {['nurses', 'doctors', 'neighbours'][k % 3]} had {k % 17} questions about the {['wave', 'season', 'shots'][k % 3]}."


TABLE = "\n".join(f"Ward {k} | beds {k * 7} | staff {k * 13}" for k in range(12))


def test_quality_flags(spark):
    data = [(i, t, "en" if i % 2 else None) for i, t in enumerate(CASES)] + [(100 + i, ordinary(i), "en") for i in range(80)] + [(999, None, "en"), (998, PROSE * 3000, "es")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = {r.id: r for r in quality.quality(df, "doc_id", "text", "lang").collect()}
    assert len(out) == len(data)
    assert all(out[i].not_prose == exact(t) for i, t, _ in data)
    assert "longest_word" in out[list(CASES).index("lllffifaagggyyyhhhdddyyffyykkkjgeeguiii" * 9)].tails
    assert all((r.prose_share is None) == (r.decided_by == "tails") for r in out.values())


@pytest.mark.parametrize("share", [0.14, 0.4, 0.8])
def test_common_junk_is_found_as_well(spark, share):
    data = [(i, TABLE + f" | {i}" if i < share * 1000 else ordinary(i), "en") for i in range(1000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = quality.quality(df, "doc_id", "text", "lang").collect()
    assert {r.id: r.not_prose for r in out} == {i: i < share * 1000 for i in range(1000)}
    assert sum(r.decided_by == "tails" for r in out) > 900


def test_the_sketches_decide(spark, monkeypatch):
    """Junk and prose are told apart by the tails; with sketches of something else the tails decide nothing."""
    data = [(i, TABLE if i % 5 == 0 else ordinary(i), "en") for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    by_tails = lambda: quality.quality(df, "doc_id", "text", "lang").filter("decided_by = 'tails'").count()
    assert by_tails() > 350
    levels_of = quality.levels_of
    monkeypatch.setattr(quality, "levels_of", lambda s: levels_of(s).withColumn("ended_line_share", F.struct(F.lit(9.0).alias("mid"), F.lit(0.1).alias("spread"))).withColumn("common_word_share", F.struct(F.lit(0.0).alias("mid"), F.lit(0.01).alias("spread"))))
    assert by_tails() == 0


def test_without_enough_texts_no_tail_decides(spark):
    df = spark.createDataFrame([(i, ordinary(i), "en") for i in range(20)] + [(50, TABLE, "en")], "doc_id long, text string, lang string")
    out = {r.id: r for r in quality.quality(df, "doc_id", "text", "lang").collect()}
    assert {r.decided_by for r in out.values()} == {"lines"} and [i for i, r in out.items() if r.not_prose] == [50]


def test_quality_of_nothing(spark):
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect() == []


def test_sketches_merge_to_the_whole(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"), *[F.col("id").cast("double").alias(s) for s in quality.STATISTICS if s != "common_word_share"], F.when(F.col("id") % 2 == 0, 0.5).otherwise(0.0).alias("common_word_share")).filter("id > 0")
    sketches = quality.language_sketches(df)
    assert {(r.lang, r.reads) for r in sketches.collect()} == {(x, y) for x in "ab*" for y in (True, False)}
    mid = {r.lang: r["values"][1] for r in quality.quantiles(quality.merged(sketches, "lang")).filter("statistic = 'words'").collect()}
    assert all(abs(v - 2500) < 120 for v in mid.values()) and set(mid) == {"a", "b", "*"}
