"""Phrase mining, ranked search and exact duplicates against brute force, and odd input."""

import glob
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from merchlens.llm import exact, phrases, treap
from merchlens.llm.common import BATCH_BYTES, small_batches

WORDS = "lamp desk chair phone cable mat mug bag tent rope".split()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- phrases -----------------------------------------------------------------------------


def brute_phrases(rows, least, most, top):
    counts, totals, out = {}, Counter(), []
    for language, text in rows:
        language = "und" if language is None else language
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[language] += len(w)
            f = counts.setdefault(language, Counter())
            for i in range(len(w)):
                for k in range(1, min(most, len(w) - i) + 1):
                    f[tuple(w[i : i + k])] += 1
    for language, f in counts.items():
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        inside = {}
        for p in candidates:
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside.get(p[i:j], 0), f[p])
        rows_of = []
        for p in candidates:
            if inside.get(p, 0) >= f[p]:
                continue
            n = totals[language]
            score, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_of.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        out += [(language, r, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y, n) in enumerate(sorted(rows_of)[:top], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in phrases.mine_phrases(df, **options).collect())


@pytest.fixture(scope="module")
def phrase_rows():
    rng = np.random.default_rng(2)
    passage = "the quick brown fox jumps over the lazy dog near an old red barn"
    texts = [" ".join(rng.choice(WORDS, rng.integers(0, 30), p=np.arange(10, 0, -1) / 55)) for _ in range(150)]
    texts += [f"{rng.choice(WORDS)} {passage} {rng.choice(WORDS)}" for _ in range(25)] + [passage] * 3
    texts += ["a a a a a a a a", "ring road ring road ring road ring road ring road ring", "Stop.Go;stop go\x0bstop\tgo,, go  stop!", "É é LAMP Lamp", None, "", " . ", "x" * 9000 + " y" * 4000]
    return [(i, [None, "en", "fr", "und"][int(rng.integers(0, 4))], t, "clash", 1) for i, t in enumerate(texts)]


PHRASE_SCHEMA = "id long, language string, description string, phrase string, n long"


@pytest.mark.parametrize("least,most,top", [(3, 5, 2000), (8, 5, 7), (2, 3, 2000), (4, 2, 2000), (1, 4, 2000)])
def test_phrases_against_brute_force(spark, phrase_rows, least, most, top):
    df = spark.createDataFrame(phrase_rows, PHRASE_SCHEMA).repartition(5)
    want = brute_phrases([(r[1], r[2]) for r in phrase_rows], least, most, top)
    assert mined(df, min_count=least, max_words=most, top=top) == want and len(want) > 5


def test_repeated_rows_count_and_nothing_gives_nothing(spark, phrase_rows):
    df = spark.createDataFrame(phrase_rows[:40] * 3, PHRASE_SCHEMA)
    assert mined(df, min_count=6) == brute_phrases([(r[1], r[2]) for r in phrase_rows[:40]] * 3, 6, 5, 2000)
    assert mined(df.limit(0)) == []


def test_saturated_filters_only_cost_time(spark, phrase_rows, monkeypatch):
    want = brute_phrases([(r[1], r[2]) for r in phrase_rows], 3, 5, 2000)
    monkeypatch.setattr(phrases.Frequent, "has", lambda self, slots: np.ones(len(slots), bool))
    words = phrases.Words(["a b, c d e"], [None])
    assert [list(map(int, alive)) for alive in words.runs(3, [])] == [[1, 1, 1, 1, 1], [1, 0, 1, 1, 0], [0, 0, 1, 0, 0]]
    assert mined(spark.createDataFrame(phrase_rows, PHRASE_SCHEMA), min_count=3) == want


def test_counts_of_many_tasks_add_up(spark, phrase_rows, monkeypatch):
    monkeypatch.setattr(phrases, "ADDED", 2)
    df = spark.createDataFrame(phrase_rows, PHRASE_SCHEMA).repartition(7)
    assert mined(df, min_count=300) == brute_phrases([(r[1], r[2]) for r in phrase_rows], 300, 5, 2000)
    kept = [phrases._frequent(df.select("language", F.col("description").alias("text")).mapInArrow(phrases._count_slots([], n), "task long, section int, data binary, language string, n long"), n) for n in (1, 300)]
    words = phrases.Words(["lamp rope unheard"], ["en"])
    assert kept[0].has(words.slots(1)).tolist() == [True, True, False] and not kept[1].has(words.slots(1))[2]


def test_filters_grow_with_the_words(spark, monkeypatch):
    # with 2^19 slots for 600,000 words every tenth slot would count three or more of pairs that occur once
    rng = np.random.default_rng(4)
    texts = [[f"w{j}" for j in rng.integers(0, 3000, 20000)] for _ in range(30)]
    df = spark.createDataFrame([(" ".join(t), "en") for t in texts], "description string, language string").repartition(3)
    made = []
    monkeypatch.setattr(phrases, "SLOT_BITS", 19)
    monkeypatch.setattr(phrases, "CROWD", 1, raising=False)
    monkeypatch.setattr(phrases, "_frequent", lambda *a, f=phrases._frequent: made.append(f(*a)) or made[-1])
    counts, _, _ = phrases.phrase_counts(df, "language", "description", 3, 5)
    pairs = Counter(" ".join(p) for t in texts for p in zip(t, t[1:]))
    assert {r.phrase: r.n for r in counts.where("words = 2").collect()} == {p: n for p, n in pairs.items() if n >= 3}
    assert np.unpackbits(made[1].bits).mean() < 0.05
    assert phrases._slot_bits(0) == 19 and phrases._slot_bits(600_000) == 20 and phrases._slot_bits(10**12) == phrases.MOST_BITS


def test_small_partitions_do_not_multiply_counted_runs(spark, tmp_path, monkeypatch):
    # each task makes a row for each run it counts, so tasks must not be as many as the input's pieces
    cores = spark.sparkContext.defaultParallelism
    rows = [("a b c d e f, g h", "en"), ("a b c, x y", "en"), ("a b c d e f", None)] * 40 * cores
    df = spark.createDataFrame(rows, "description string, language string").repartition(10 * cores)

    def noted(filters, most, f=phrases._count_runs, folder=str(tmp_path)):
        count = f(filters, most)

        def note(batches):
            for i, batch in enumerate(count(batches)):
                with open(f"{folder}/{TaskContext.get().partitionId()}-{i}", "w") as out:
                    out.write(str(batch.num_rows))
                yield batch

        return note

    monkeypatch.setattr(phrases, "_count_runs", noted)
    assert mined(df, min_count=3) == brute_phrases([(r[1], r[0]) for r in rows], 3, 5, 2000)
    made = sum(int(f.read_text()) for f in tmp_path.iterdir())
    assert 0 < made <= 2 * cores * 19  # runs that differ
    monkeypatch.setattr(phrases, "TASK_WORDS", 100)
    assert phrases._for_cores(df, 300 * cores).rdd.getNumPartitions() == 3 * cores
    assert phrases._for_cores(df.repartition(1), 10**9).rdd.getNumPartitions() == 1


def test_unary_paths(spark):
    # a passage that always stands alone is one path; a place where ways part ends it
    text = ["a b c d e f g h"] * 3 + ["p q r s t u", "p q r s t v"] * 2 + ["z z z z z z z z"] * 2
    df = spark.createDataFrame([(t, "en") for t in text], "description string, language string")
    _, _, paths = phrases.phrase_counts(df, "language", "description", 2, 5)
    got = {(r.phrase, r.n, r.n_edges) for r in paths.collect()}
    assert got == {("a b c d e f g h", 3, 4), ("p q r s t", 4, 1), ("q r s t u", 2, 1), ("q r s t v", 2, 1), ("z z z z z", 8, 1)}


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    row = spark.range(1).select(*[F.lit(v).cast("decimal(38,0)").alias(c) for c, v in (("a", big), ("n", big * 1000), ("l", big + 7), ("r", big + 9))])
    got = row.select(F.expr("(cast(1000 as decimal(38,0)) * a * n) div (l * r)")).head()[0]
    assert got == 1000 * big * big * 1000 // ((big + 7) * (big + 9))


# --- search ------------------------------------------------------------------------------


def brute_search(rows, questions, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    docs = [(i, Counter(terms(t))) for i, t in rows]
    held = [c for _, c in docs if c]
    n_texts, n_terms, df = len(held), sum(map(lambda c: sum(c.values()), held)), Counter(t for c in held for t in c)
    out = []
    for q, text in questions:
        scored = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n_texts // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_texts + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda r: (r[0], r[1], 0 if r[2] is None else r[2]))
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(scored[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def searched():
    rng = np.random.default_rng(5)
    names = WORDS + [f"w{i}" for i in range(300)]
    odds = 1 / np.arange(1, len(names) + 1)
    texts = [" ".join(rng.choice(names, rng.integers(0, 60), p=odds / odds.sum())) for _ in range(300)]
    texts += texts[:30] + [None, "", "-- !!", "ÉTÉ été Été", "Lamp," * 700, "Z" * 5000, "x9 X9 9x"]
    return [(i if i != 17 else None, t, "clash", 1.0) for i, t in enumerate(texts)] + [(2**53 + 1, texts[3], "", 0.0), (2**53 + 1, texts[3], "", 0.0)]


SEARCH_SCHEMA = "id long, description string, terms string, score double"
ASKED = [(1, "Lamp lamp desk w5 w17"), (2, "w1 w2 w3 w4 w250 tent"), (3, None), (4, "nothing known"), (5, "été x9"), (6, "w7"), (6, "w7"), (None, "mug"), (8, " ".join(WORDS * 3))]


@pytest.mark.parametrize("rows,first", [(4096, 16), (50, 16), (7, 2)])
def test_search_against_brute_force(spark, tmp_path, searched, monkeypatch, rows, first):
    monkeypatch.setattr(treap, "SHARD_ROWS", rows)
    df = spark.createDataFrame(searched, SEARCH_SCHEMA).repartition(3)
    questions = spark.createDataFrame(ASKED, "id long, description string")
    treap.index_products(df, str(tmp_path / "index"))
    for k in (first, 20):
        got = Counter(tuple(r) for r in treap.search_products(spark, str(tmp_path / "index"), questions, k).collect())
        assert got == brute_search([r[:2] for r in searched], ASKED, k)


def test_many_blocks_of_questions_and_text_ids(spark, tmp_path, searched, monkeypatch):
    monkeypatch.setattr(treap, "BLOCK", 4)
    rows = [(None if r[0] is None else f"p{r[0]}", r[1]) for r in searched]
    asked = [(f"q{i}", f"w{i} w{i + 1} lamp") for i in range(30)]
    treap.index_products(spark.createDataFrame(rows, "id string, description string"), str(tmp_path / "index"))
    found = treap.search_products(spark, str(tmp_path / "index"), spark.createDataFrame(asked, "id string, description string"), 20)
    want = brute_search([(r[0] or "~", r[1]) for r in rows], asked, 20)
    assert Counter((q, r, i or "~", s) for q, r, i, s in found.collect()) == want


def test_workers_get_one_large_grid_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(treap, "SHARD_BYTES", 1 << 20)
    texts = [" ".join(f"t{i}x{j}" for j in range(20_000)) for i in range(36)]  # about 200 kB each
    index = str(tmp_path / "index")
    treap.index_products(spark.createDataFrame(list(enumerate(texts)), "id long, description string").coalesce(1), index)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{index}/grids/*.parquet")]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert len(groups) > 5 and set(groups) == {1}
    made = treap._search

    def noted(k, kind):
        search = made(k, kind)

        def watched(batches):
            for batch in batches:
                assert batch.num_rows == 1, (batch.num_rows, batch.nbytes)
                yield batch

        return lambda batches: search(watched(batches))

    monkeypatch.setattr(treap, "_search", noted)
    before = spark.conf.get(BATCH_BYTES, None)
    asked = spark.createDataFrame([(1, "t3x7 t35x0"), (2, "t9x9 t9x10")], "id long, description string")
    found = treap.search_products(spark, index, asked).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.rank, r.id) for r in found] == [(1, 1, 3), (1, 2, 35), (2, 1, 9)]
    assert spark.conf.get(BATCH_BYTES, None) == before


def test_tasks_make_grids_of_a_few_partitions(spark, tmp_path, searched, monkeypatch):
    monkeypatch.setattr(treap, "WAVES", 0)
    monkeypatch.setattr(treap, "SHARD_ROWS", 50)
    df = spark.createDataFrame(searched, SEARCH_SCHEMA).repartition(10)
    treap.index_products(df, str(tmp_path / "index"))
    files = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/index/grids/*.parquet")]
    assert len(files) == 3 and sum(files) <= 9  # 338 descriptions; each partition has a grid at least
    asked = spark.createDataFrame(ASKED, "id long, description string")
    got = Counter(tuple(r) for r in treap.search_products(spark, str(tmp_path / "index"), asked, 20).collect())
    assert got == brute_search([r[:2] for r in searched], ASKED, 20)


def test_small_batches_end_with_the_steps_within(spark):
    rows = spark.range(0, 40, 1, 1).withColumn("text", F.repeat(F.lit("x"), 200_000))

    def largest():
        return rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").agg(F.max("n")).head()[0]

    plain = largest()
    for set_before in (None, "3000000"):
        if set_before:
            spark.conf.set(BATCH_BYTES, set_before)
        try:
            with pytest.raises(ZeroDivisionError), small_batches(spark):
                assert largest() < 10
                raise ZeroDivisionError
            assert spark.conf.get(BATCH_BYTES, None) == set_before
        finally:
            spark.conf.unset(BATCH_BYTES)
    assert largest() == plain == 40


def test_search_without_documents_or_questions(spark, tmp_path, searched):
    df, questions = spark.createDataFrame(searched, SEARCH_SCHEMA), spark.createDataFrame(ASKED, "id long, description string")
    for n, (d, q) in enumerate([(df.limit(0), questions), (df, questions.limit(0)), (df.where("description IS NULL"), questions)]):
        treap.index_products(d, str(tmp_path / str(n)))
        assert treap.search_products(spark, str(tmp_path / str(n)), q).count() == 0


def test_grids_give_every_cell_back():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (1, 900), (700, 3), (40, 40), (257, 129)):
        cells = np.unique(rng.integers(0, shape[0] * shape[1], 400))
        row, col = np.divmod(cells, shape[1])
        value = rng.integers(1, 900_000, len(cells))
        grid = treap.Grid(*treap.compress_grid(row, col, value))
        for r in np.unique(row)[:20]:
            columns, sums = grid.best(np.array([r]), np.array([3]), 1000, 0)
            assert dict(zip(columns, sums)) == {c: 3 * v for c, v in zip(col[row == r], value[row == r])}
            assert (np.diff(sums) <= 0).all()


def test_few_states_are_opened_for_a_rare_term(monkeypatch):
    rng = np.random.default_rng(3)
    col, value = np.arange(4096), rng.integers(1, 1000, 4096)
    value[777] = 10**6
    grid = treap.Grid(*treap.compress_grid(np.zeros(4096, int), col, value))
    asked = []
    lexsort = np.lexsort
    monkeypatch.setattr(treap.np, "lexsort", lambda keys: asked.append(len(keys[0])) or lexsort(keys))
    columns, _ = grid.best(np.array([0]), np.array([1]), 1, 0)
    assert columns.tolist() == [777] and len(asked) * treap.FIRST < 1000  # of 8191 ranges


# --- exact duplicates --------------------------------------------------------------------


def brute_classes(rows):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i))
    out = []
    for text, members in groups.items():
        stays = min(members, key=lambda m: (m[0], m[1], 0 if m[2] is None else m[2]))
        kept = 1
        for m in members:
            out.append((m[2], stays[2], len(members), m == stays and kept > 0, hashlib.sha256(text.encode()).hexdigest()))
            kept -= m == stays
    return Counter(out)


def dedup_rows():
    rng = np.random.default_rng(9)
    base = [" ".join(rng.choice(WORDS, rng.integers(1, 5))) for _ in range(200)]
    texts = base + [t.replace(" ", "\n\t ") for t in base[:60]] + [t.replace(" ", "") for t in base[50:90]]
    texts += [None, "", " \n", "\x0b\x0c\r", "a b", "ab", "a b", "é" * 4000, "é " * 4000, "hot copy"] + ["hot copy", "hot  copy"] * 150
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (2**53 + 1, "b1g"), (2**53 + 3, "b1 g"), (None, "b1g"), (None, "b1g")]


def classes(spark, rows, store, parts, **options):
    frames = [spark.createDataFrame([(*r, "clash", 1) for r in rows[i::parts]], "id long, description string, name string, row int").repartition(3) for i in range(parts)]
    return Counter(tuple(r) for r in exact.dedup_batches(frames, str(store), **options).collect())


@pytest.mark.parametrize("parts", [1, 3])
def test_classes_against_brute_force(spark, tmp_path, parts, monkeypatch):
    monkeypatch.setattr(exact, "BUCKET_KEYS", 20)
    monkeypatch.setattr(exact, "SCREENED", 15)
    rows = dedup_rows()
    assert classes(spark, rows, tmp_path / "s", parts) == brute_classes(rows)


def test_bytes_decide_where_digests_clash(spark, tmp_path):
    rows = dedup_rows()[:260]
    weak = lambda t: F.substring(t, 1, 1)
    got = classes(spark, rows, tmp_path / "s", 2, digest=weak)
    want = brute_classes(rows)
    assert Counter(r[:4] for r in got.elements()) == Counter(r[:4] for r in want.elements())


def test_only_texts_that_filters_pass_are_joined(spark, tmp_path):
    old = [(i, f"old {i}") for i in range(500)]
    new = [(1000 + i, f"new {i}") for i in range(500)] + [(2000, "old 7"), (2001, " o l d 7"), (2002, "new 3")]
    frames = [spark.createDataFrame(r, "id long, description string") for r in (old, new)]
    got = {r.id: r for r in exact.dedup_batches(frames, str(tmp_path / "s")).collect()}
    passed = spark.read.parquet(f"{tmp_path}/s/000001/passed")
    assert 1 <= passed.count() < 20 and spark.read.parquet(f"{tmp_path}/s/000001/found").count() == 1
    assert got[7].keep_id == got[2000].keep_id == got[2001].keep_id == 2001 and got[7].group_size == 3
    assert got[1003].kept and not got[2002].kept and got[1004].group_size == 1


def test_unfinished_and_empty_batches(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (3, "a ")]
    df, store = spark.createDataFrame(rows, "id long, description string"), str(tmp_path / "s")
    assert exact.add_batch(df.limit(0), store) == 0 and exact.duplicate_classes(spark, store).count() == 0
    assert exact.add_batch(df, store) == 1
    df.limit(0).write.parquet(f"{store}/000002/texts")  # a run that failed before its filters were written
    assert exact.add_batch(df, store) == 2
    got = Counter((r.id, r.keep_id, r.group_size, r.kept) for r in exact.duplicate_classes(spark, store).collect())
    assert got == Counter({(1, 3, 4, False): 2, (2, 2, 2, True): 1, (2, 2, 2, False): 1, (3, 3, 4, True): 1, (3, 3, 4, False): 1})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 3000])
def test_filters_hold_their_keys(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63, n)
    made = exact.Fuse.build(np.concatenate([keys, keys]))
    assert made.holds(keys).all() and made.holds(rng.integers(-(2**63), 2**63, 20_000)).mean() < 0.01
    assert len(made.slots) <= max(24, 2 * n)

