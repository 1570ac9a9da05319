"""The pipeline, stage by stage, against brute force on what each stage was given."""

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from tessera.llm import toxicity
from tessera.llm.shared import cut

from .test_texts import brute_components, brute_contamination

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(cut(stage(spark, out[-1], data), f"test-{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(staged):
    assert [name for name, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "mixing"]
    assert all(df.columns == COLUMNS for df in staged[:-1])


def test_toxicity(spark, data, staged):
    labels = spark.read.parquet(f"{data}/labels.parquet").filter(~toxicity.held_out())
    bad = {r["doc_id"] for r in toxicity.score(staged[0], toxicity.train(staged[0], labels)).filter("predicted = 1").collect()}
    assert set(rows(staged[1])) == set(rows(staged[0])) - bad


def test_near_copies(staged):
    want = {k for k, (_, _, kept) in brute_components([(k, r["text"]) for k, r in rows(staged[1]).items()]).items() if kept}
    assert set(rows(staged[2])) == want


def test_repeated_rows_through_two_stages(spark, data):
    long, other = (" ".join(f"{name}{k}" for k in range(80)) for name in ("word", "other"))
    lone = " ".join(f"lone{k}" for k in range(80))
    got = [(5, long), (5, long), (3, other), (9, other), (9, lone), (7, None), (7, None), (None, "a b"), (None, "a b")]
    docs = spark.createDataFrame([(k, t, "en", "src0", len(t or "")) for k, t in got], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cut(P.drop_near_copies(spark, docs, data), "test-repeated")
    order = lambda found: sorted(((r["doc_id"], r["text"]) for r in found), key=str)
    assert order(kept.collect()) == sorted([(5, long), (3, other), (9, lone), (7, None), (None, "a b")], key=str)
    after = P.cut_repeats(spark, kept, data)
    assert {(5, long), (3, other), (9, lone)} <= set(order(after.collect()))


LONG = {name: " ".join(f"{name}{k}" for k in range(80)) for name in ("word", "other", "lone")}


def small_tables(spark, folder, docs, ids="long", **more):
    """The three tables of a pipeline, without labels and benchmark."""
    df = spark.createDataFrame([(k, t, None, None, len(t or "")) for k, t in docs], f"doc_id {ids}, text string, lang string, source string, n_chars long")
    for name, value in more.items():
        df = df.withColumn(name, value)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], f"doc_id {ids}, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    folder = small_tables(spark, tmp_path / "none", [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = cut(stage(spark, docs, folder), f"empty-{name}")
        assert docs.columns == COLUMNS and docs.count() == 0
    assert P.run(spark, folder).count() == 0


@pytest.mark.parametrize("ids", ["long", "string"])
def test_nulls_copies_and_columns_of_the_caller(spark, tmp_path, ids):
    """Names that the operators compute are the caller's all the way; ids of both kinds, nulls in all other columns."""
    from pyspark.sql import functions as F

    known = [(1, LONG["word"]), (2, LONG["word"]), (3, LONG["other"]), (4, None), (5, ""), (6, LONG["lone"]), (6, LONG["lone"])]
    mine = ["score", "predicted", "n_bytes", "n_removed", "kept_text", "key", "id", "row", "n", "spans", "h", "g", "t__", "domain", "Contaminated", "with.dot"]
    folder = small_tables(spark, tmp_path / ids, [(str(k) if ids == "string" else k, t) for k, t in known], ids, **{c: F.lit("mine") for c in mine})
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = cut(stage(spark, docs, folder), f"clash-{name}")
        assert docs.columns == names, name
        assert all(r[c] == "mine" for r in docs.collect() for c in mine), name
    assert sorted((int(r["doc_id"]), r["text"]) for r in docs.filter("text <> ''").collect()) == [(1, LONG["word"]), (3, LONG["other"]), (6, LONG["lone"])]
    assert sorted(int(r["doc_id"]) for r in docs.filter("coalesce(text, '') = ''").collect()) == [4, 5]
    assert sorted(int(r["doc_id"]) for r in P.run(spark, folder).collect()) == [1, 3, 6]


def test_settled_keeps_tables_of_other_threads(spark):
    import threading

    from tessera.llm import shared

    go, done, other = threading.Event(), threading.Event(), []

    def beside():
        go.wait()
        other.append(cut(spark.range(3), "test-beside"))
        done.set()

    thread = threading.Thread(target=beside)
    thread.start()

    def make():
        inner = cut(spark.range(5), "test-inner")
        go.set()
        done.wait()
        return inner

    before = set(shared._made)
    out = shared.settled(make, "test-outer")
    thread.join()
    assert out.count() == 5 and other[0].count() == 3
    assert set(shared._made) - before == {out._tessera_path, other[0]._tessera_path}


def cut_by_hand(texts, length=200):
    raw = {k: (t or "").encode() for k, t in texts.items()}
    seen = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in raw.items():
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        # a character goes only if all of its bytes do
        kept, at = [], 0
        for c in b.decode():
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out[k] = "".join(kept)
    return out


def test_repeats(staged):
    before, after = rows(staged[2]), rows(staged[3])
    want = cut_by_hand({k: r["text"] for k, r in before.items()})
    assert {k: r["text"] for k, r in after.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_decontamination(spark, data, staged):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    before = rows(staged[3])
    verdicts = brute_contamination([r["text"] for r in before.values()], items)
    assert set(rows(staged[4])) == {k for k, v in zip(before, verdicts) if not v[4]}


def share_out(children, total):
    """children: name -> (weight, capacity). Fills the smallest claims first, as long as they fit their share."""
    open_, left, got = dict(children), total, {}
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = [k for k, (w, c) in open_.items() if c * weight <= w * left]
        if not full:
            floors = {k: w * left // weight for k, (w, _) in open_.items()}
            order = sorted(open_, key=lambda k: (-(open_[k][0] * left % weight), k))
            return got | floors | {k: floors[k] + 1 for k in order[: left - sum(floors.values())]}
        k = min(full, key=lambda x: open_[x][1] / open_[x][0])
        got[k] = open_[k][1]
        left -= open_.pop(k)[1]
    return got


def test_mixing(staged):
    from tessera.llm.mixing import WEIGHTS

    domain = lambda s: "web" if s in {f"src{k}" for k in range(6)} else "books" if s in {f"src{k}" for k in range(6, 13)} else "code"
    docs = [(r["doc_id"], domain(r["source"]), r["lang"] or "(none)", r["source"] or "(none)", len([w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in r["text"] or "").split(" ") if w])) for r in rows(staged[4]).values()]
    docs = [d for d in docs if d[4]]
    tokens = Counter()
    for _, d, lang, s, n in docs:
        tokens[d, lang, s] += n
    weight = lambda level, k: WEIGHTS[level].get(k, 1)
    budget = {(): sum(tokens.values())}
    for depth, level in enumerate(("domain", "lang", "source"), 1):
        nodes = defaultdict(dict)
        for leaf, n in tokens.items():
            w, c = nodes[leaf[: depth - 1]].get(leaf[depth - 1], (weight(level, leaf[depth - 1]), 0))
            nodes[leaf[: depth - 1]][leaf[depth - 1]] = (w, c + 2 * n)
        budget = {(*up, k): v for up, children in nodes.items() for k, v in share_out(children, budget[up]).items()}
    want = set()
    for leaf, total in budget.items():
        for epoch in (0, 1):
            order = sorted((hashlib.md5(f"42/{epoch}/{k}".encode()).hexdigest(), k, n) for k, *path, n in docs if tuple(path) == leaf)
            for _, k, n in order:
                if total < n:
                    total = -1
                    break
                total -= n
                want.add((k, epoch))
            if total < 0:
                break
    assert {(r["doc_id"], r["epoch"]) for r in staged[5].collect()} == want


def test_registered(spark, data):
    import __spark_entry__ as e

    assert e.queries()["pipeline"].__wrapped__ is P.run and "pipeline" not in e.oracle_sql()
