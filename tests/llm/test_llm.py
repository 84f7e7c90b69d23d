"""Operators of the training-data subpackage: exact round trips, brute force, held-out accuracy, edge cases."""

import itertools
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import nearest, packing, reading, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


# ---------------------------------------------------------------- 7 encoding
HARD = [
    None, "", " ", "\n\n  \n", "don't we'll 'x' 12ab 3.5e+7 ...", "a" * 700, "<|endoftext|> [PAD]", "ﬁber 한글 光パルス 👩‍🔬 x​y‍z",
    "  leading\t\ttabs  and   runs   ", "word " * 400, ("x" * 90 + "  \n") * 20, "'" * 300 + "'re" * 50, "日本語" * 200,
]


def direct(text):
    return tokens.encoding(tokens.VOCABULARY).encode_ordinary(text) if text else []


@pytest.mark.parametrize("chunk,overlap", [(16, 8), (64, 24), (16_384, 512)])
def test_chunked_encoding_is_exact(spark, chunk, overlap):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(HARD + HARD[5:9])], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: direct(t) for i, t in enumerate(HARD + HARD[5:9])}
    n = {r.doc_id: r.n_tokens for r in tokens.encode_corpus(df, count_only=True, chunk=chunk, overlap=overlap).collect()}
    assert n == {i: len(v) for i, v in got.items()}
    assert all(tokens.decode(got[i]) == (t or "") for i, t in enumerate(HARD))


def test_encoding_keeps_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "x " * 30), (1, "x " * 30), (None, "y " * 30)], "doc_id long, text string")
    assert sorted((r.doc_id is None, len(r.ids)) for r in tokens.encode_corpus(df, chunk=20, overlap=8).collect()) == sorted((i is None, len(direct(t))) for i, t in [(None, "a b"), (1, "x " * 30), (1, "x " * 30), (None, "y " * 30)])
    assert tokens.encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 .'\n\tst재"), max_size=300), st.integers(8, 40))
def test_stitching_property(text, chunk):
    overlap, n = 12, max(1, -(-len(text) // chunk))
    run = tokens._ends(chunk, overlap)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["k"] * n), pa.array(range(n), pa.int32()), pa.array([i == n - 1 for i in range(n)]), pa.array([text[i * chunk : (i + 1) * chunk + overlap] for i in range(n)])], names=["key", "i", "last", "chunk"])
    ends = next(run(iter([batch]))).to_pydict()
    cuts = [min(c) for i in range(n - 1) if (c := set(ends["tail"][i]) & set(ends["head"][i + 1]))]
    at = [0, *sorted(set(cuts)), len(text)]
    assert [x for a, b in zip(at, at[1:]) for x in direct(text[a:b])] == direct(text)


# ---------------------------------------------------------------- 8 containers
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8), st.integers(1, 60))
def test_best_fill_is_the_best(items, room):
    counts = Counter(items)
    fill = packing.best_fill(dict(counts), sorted(counts, reverse=True), room)
    best = max((sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room), default=0)
    assert sum(n * c for n, c in fill.items()) == best and all(c <= counts[n] for n, c in fill.items())


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(0)
    sizes = [*rng.integers(1, 120, 3000).tolist(), 0, 0, None, 100, 101, 250, 1000]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int").withColumn("length", F.lit("clash"))
    p = packing.pack(df, "doc_id", "n", 100).toPandas()
    assert p.groupby("doc_id").length.sum().to_dict() == {i: n or 0 for i, n in enumerate(sizes)}
    used = p.groupby("container_id").length.sum()
    total = sum(n or 0 for n in sizes)
    assert used.max() <= 100 and len(used) <= -(-total // 100) + 1
    parts = p.groupby("doc_id").size()
    assert all(parts[i] == max(1, -(-(n or 0) // 100)) for i, n in enumerate(sizes))
    assert p.sort_values(["doc_id", "piece"]).groupby("doc_id").start.apply(lambda s: (np.diff(s) == 100).all()).all()
    again = packing.pack(df.orderBy(F.desc("doc_id")), "doc_id", "n", 100).toPandas()
    assert p.sort_values(["doc_id", "piece"]).container_id.tolist() == again.sort_values(["doc_id", "piece"]).container_id.tolist()
    assert packing.pack(df.limit(0), "doc_id", "n", 100).count() == 0
    assert packing.pack(df.where("n = 0"), "doc_id", "n", 100).toPandas().container_id.tolist() == [0, 0]


def first_fit_decreasing(sizes, room):
    rest: list[int] = []
    for n in sorted(sizes, reverse=True):
        at = next((i for i, r in enumerate(rest) if r >= n), None)
        if at is None:
            rest.append(room - n)
        else:
            rest[at] -= n
    return len(rest)


def test_many_items_of_one_awkward_length(spark):
    rng = np.random.default_rng(0)
    sizes = [*rng.integers(1, 101, 3000).tolist(), *[37] * 1500]
    p = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int"), "doc_id", "n", 100).toPandas()
    used = p.groupby("container_id").length.sum()
    assert used.max() <= 100 and used.sum() == sum(sizes) and len(used) <= 1.02 * first_fit_decreasing(sizes, 100)


def test_patterns_use_up_the_histogram():
    hist = {7: 1000, 13: 401, 50: 3, 99: 77, 100: 5}
    plan = packing.plan_patterns(hist, 100)
    used = Counter()
    for times, fill in plan:
        assert sum(n * c for n, c in fill.items()) <= 100
        used.update({n: times * c for n, c in fill.items()})
    assert dict(used) == hist and packing.plan_patterns({}, 100) == []


# ---------------------------------------------------------------- 3 nearest in time
@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=300), st.lists(st.floats(-10, 1.1e6), min_size=1, max_size=50), st.integers(1, 20))
def test_learned_index_bounds(keys, queries, error):
    k = np.unique(np.array(keys))
    lo, hi = nearest.LearnedIndex(k, error).window(np.array(queries))
    at = np.searchsorted(k, np.array(queries))
    assert ((lo <= at) & (at <= hi)).all() and (hi - lo <= 2 * error + 3).all()


@pytest.mark.parametrize("crowd", [200_000, 30])
def test_nearest_against_brute_force(spark, crowd):
    rng = np.random.default_rng(crowd)
    left = [(i, 7 if rng.random() < 0.5 else int(rng.integers(0, 4)), None if i % 40 == 0 else float("nan") if i % 41 == 0 else round(float(rng.uniform(0, 2000)), 1)) for i in range(400)]
    right = [(1000 + i, 7 if rng.random() < 0.5 else None if i % 50 == 0 else int(rng.integers(0, 4)), None if i % 45 == 0 else round(float(rng.uniform(0, 2000)), 1)) for i in range(400)]
    l = spark.createDataFrame(left + left[:5], "cand_id long, ent int, t double").withColumn("id", F.lit("clash"))
    r = spark.createDataFrame(right + right[:5], "flash_id long, ent int, t double")
    got = {x.left_id: (x.right_id, round(x.dist, 6)) for x in nearest.nearest_in_time(l, r, ["ent"], 5.0, "cand_id", "flash_id", F.col("t"), F.col("t"), crowd).collect()}
    want = {}
    for i, e, t in left:
        if t is not None and t == t:
            near = sorted((abs(t - u), j) for j, f, u in right if f is not None and f == e and u is not None and abs(t - u) <= 5)
            if near:
                want[i] = (near[0][1], round(near[0][0], 6))
    assert got == want
    assert nearest.nearest_in_time(l.limit(0), r, ["ent"], 5.0, "cand_id", "flash_id", F.col("t"), F.col("t")).count() == 0
    assert nearest.nearest_in_time(l, r.limit(0), ["ent"], 5.0, "cand_id", "flash_id", F.col("t"), F.col("t")).count() == 0


def test_a_crowded_entity_is_linear_work(spark, monkeypatch):
    """One entity holds 200 times the rows of a group, a third of them at one instant; the probed rows stay in proportion."""
    rng = np.random.default_rng(4)
    n = 6000
    t = np.where(rng.random(n) < 0.3, 100.0, rng.integers(0, 9600, n) / 32)
    u = np.where(rng.random(n) < 0.3, 103.0, rng.integers(0, 9600, n) / 32)
    l = spark.createDataFrame([(i, 1, float(x)) for i, x in enumerate(t)], "cand_id long, ent int, t double")
    r = spark.createDataFrame([(10_000 + i, 1, float(x)) for i, x in enumerate(u)], "flash_id long, ent int, t double")
    cut = nearest._cut_crowded
    sizes = []

    def counted(*a):
        out = cut(*a)
        sizes.append([df.groupBy("bucket", "slab", "cut", "salt").count().agg(F.sum("count"), F.max("count")).first() for df in out])
        return out

    monkeypatch.setattr(nearest, "_cut_crowded", counted)
    got = {x.left_id: (x.right_id, round(x.dist, 6)) for x in nearest.nearest_in_time(l, r, ["ent"], 5.0, "cand_id", "flash_id", F.col("t"), F.col("t"), 30).collect()}
    first = {}
    for j, v in zip(range(10_000, 10_000 + n), u):
        first.setdefault(v, j)
    keys = np.array(sorted(first))
    for i, x in enumerate(t):
        k = np.searchsorted(keys, x)
        near = min((round(abs(x - keys[j]), 6), first[keys[j]]) for j in (k - 1, k) if 0 <= j < len(keys))
        assert (i in got) == (near[0] <= 5) and (i not in got or got[i] == (near[1], near[0]))
    (all_l, most_l), (all_r, most_r) = sizes[0]
    assert all_l == n and all_r < 3 * n and most_l <= 60 and most_r <= 90


# ---------------------------------------------------------------- 9 reading level
EASY = "The cat sat on the mat and it was a warm day. We can see the dog run to the big red barn. It is fun to play with a ball in the sun. "
MIDDLE = "The operator checks the pressure of the system before the next test is started, and then writes a short report for the following shift. "
HARD_TEXT = "Notwithstanding the comparatively restricted acceptance, the heteroscedastic parametrisation necessitates a perturbative expansion, thereby precluding an unambiguous attribution of residual discrepancies. "


def test_prose_is_told_from_the_rest():
    log = "2024-01-01 12:00 ERROR adc_clip_60: 12041\n| 29 | 35.865 | ok |\nfor t in range(13):\n    mask[25] = x > 60705\n4f 1a 22 9b c3\n"
    german = "Der neue Detektor verliert größere Abweichungen als gestern, weil die Pumpe noch kühlt. " * 6
    assert reading.describe(log * 5)[0] == 0 and reading.describe(german)[0] == 0 and reading.describe(None)[0] == 0 and reading.describe(" \n")[0] == 0
    n = reading.describe(EASY * 2)[0]
    assert n == len((EASY * 2).split()) and reading.describe(EASY * 2 + "\n\n" + log * 9)[0] == n
    assert reading.describe("- " + "\n- ".join((EASY * 2).split(". ")))[0] >= 60


OTHER_LANGUAGES = {
    "nl": "De nieuwe detector meet elke dag het licht van de deeltjes die door het vat gaan, en in de avond schrijft de groep een kort verslag over wat er mis ging. We hebben de pomp opnieuw gestart omdat de druk te laag was, maar na een uur was alles weer in orde. Of dat zo blijft is nog niet zeker, want de oude kabel in de kelder is erg warm. ",
    "it": "Il nuovo rivelatore misura ogni giorno la luce delle particelle che passano nel serbatoio, e la sera il gruppo scrive una breve relazione su quello che non ha funzionato. Abbiamo riavviato la pompa perché la pressione era troppo bassa, ma dopo un'ora tutto era di nuovo a posto. Non sappiamo ancora se resterà così, perché il vecchio cavo in cantina è molto caldo. ",
    "pt": "O novo detector mede todos os dias a luz das partículas que passam pelo tanque, e à noite o grupo escreve um breve relatório sobre o que correu mal. Reiniciámos a bomba porque a pressão era demasiado baixa, mas depois de uma hora tudo estava de novo em ordem. Ainda não sabemos se vai ficar assim, pois o cabo velho na cave está muito quente. ",
    "pl": "Nowy detektor mierzy codziennie światło cząstek, które przechodzą przez zbiornik, a wieczorem grupa pisze krótki raport o tym, co się nie udało. Uruchomiliśmy pompę ponownie, bo ciśnienie było za niskie, ale po godzinie wszystko znowu działało. Nie wiemy jeszcze, czy tak zostanie, bo stary kabel w piwnicy jest bardzo gorący. ",
    "sv": "Den nya detektorn mäter varje dag ljuset från de partiklar som går genom tanken, och på kvällen skriver gruppen en kort rapport om vad som gick fel. Vi startade pumpen igen eftersom trycket var för lågt, men efter en timme var allt bra igen. Om det förblir så är inte säkert, för den gamla kabeln i källaren är mycket varm. ",
}


@pytest.mark.parametrize("lang", OTHER_LANGUAGES)
def test_languages_that_no_word_list_names_are_no_case(lang):
    text = OTHER_LANGUAGES[lang]
    for t in (text, text * 3, text.replace(". ", ".\n") * 2):
        assert reading.describe(t)[0] == 0
    # English prose beside it still counts
    assert reading.describe(EASY * 2 + "\n\n" + text * 2)[0] == len((EASY * 2).split())


def test_bands_on_held_out_documents(spark):
    rng = np.random.default_rng(0)
    words = {b: [w for w in t.lower().replace(".", "").replace(",", "").split()] for b, t in zip(reading.BANDS, (EASY, MIDDLE, HARD_TEXT))}
    docs, labels, truth = [], [], {}
    for i in range(240):
        b = reading.BANDS[i % 3]
        size = {"basic": 8, "intermediate": 16, "advanced": 30}[b]
        text = " ".join(" ".join(["The", *rng.choice(words[b], size), "and", "the", "light"]) + "." for _ in range(max(2, 90 // size)))
        docs.append((i, text))
        truth[i] = b
        if i < 120:
            labels.append((i, 1, reading.BANDS[(i + 1) % 3] if i % 20 == 0 else b))
    docs += [(900, None), (901, ""), (902, "too short to be a case."), (903, "x = 1;\n" * 50)]
    labels += [(5, 2, None), (7, 2, "nonsense"), (None, 1, "basic"), (900, 1, "basic"), (9, 2, "basic"), (9, 3, "advanced")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("band", F.lit("clash"))
    l = spark.createDataFrame(labels, "doc_id long, reader_id int, band string")
    got = {r.doc_id: r.band for r in reading.reading_levels(d, l).collect()}
    assert set(got) == set(range(240))
    assert np.mean([got[i] == truth[i] for i in range(120, 240)]) > 0.95
    assert reading.reading_levels(d, l.limit(0)).count() == 0 and reading.reading_levels(d.limit(0), l).count() == 0


def test_judged_takes_clear_majorities(spark):
    l = spark.createDataFrame([(1, "basic"), (1, "basic"), (1, "advanced"), (2, "basic"), (2, "advanced"), (3, None), (4, "advanced")], "doc_id long, band string")
    assert {(r.doc_id, r.band) for r in reading.judged(l).collect()} == {(1, "basic"), (4, "advanced")}
    assert reading.judged(l, 1).count() == 1
