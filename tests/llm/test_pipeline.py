"""The pipeline's stages: each works on what the one before has kept."""

import collections
import itertools
import os
import random

import pytest

import corpus_pipeline
from chronoweave import session
from chronoweave.llm.minhash import near_duplicates
from chronoweave.llm.suffix_dedup import remove_repeats

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, stage(spark, kept, DATA)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        assert kept.columns == columns and kept.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        assert kept.count() > 0.5 * before.count(), name
    assert near_duplicates(kept.select("doc_id", "text")).where("not kept").count() <= 2  # what removed repeats leave may be alike
    assert remove_repeats(kept).where("n_removed > 0").count() == 0
    packed = corpus_pipeline.STAGES[4][1](spark, kept, DATA)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_registration():
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k[: k.index("_") + 1] for k in names if k.startswith("op")} and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)


def test_repeated_rows(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    row = lambda i, text, source="a": (i, text, "en", source, len(text) if text else 0)
    long, other, third = words("hot", 90), words("other", 90), words("third", 90)
    unlike = [row(3, words("one", 60)), row(3, words("two", 60)), row(None, words("none", 60))]
    docs = spark.createDataFrame([row(1, long, s) for s in "cab" * 10] + [row(2, long)] + [row(4, other)] * 2 + [row(5, third)] + [row(6, "")] * 2 + unlike, columns)
    kept = corpus_pipeline.near_copies(spark, docs, DATA)
    want = sorted(map(str, [row(1, long), row(4, other), row(5, third), row(6, ""), *unlike]))
    assert kept.columns == docs.columns and sorted(str(tuple(r)) for r in kept.collect()) == want
    left = corpus_pipeline.repeats(spark, spark.createDataFrame(kept.collect(), columns), DATA)
    assert sorted(str(tuple(r)) for r in left.collect()) == want


def test_repeats_rows_that_share_an_id(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    again = words("again", 60)
    texts = [(1, again), (1, again), (1, words("one", 60)), (1, "<" + words("two", 60) + again), (None, again)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts], "doc_id long, text string, n_chars long")
    left = corpus_pipeline.repeats(spark, docs, DATA)
    want = [(1, ""), (1, ""), (1, words("one", 60)), (1, "<" + words("two", 60)), (None, "")]
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str((i, t, len(t))) for i, t in want)


def test_near_copies_and_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n)]
    base, passage = words(90), " ".join(words(60))
    texts = [" ".join([*base[:k], rng.choice(base), *base[k + 1 :]]) for k in range(0, 90, 9)]
    texts += [" ".join(words(rng.randint(0, 80))) + " " + passage[rng.randint(0, 30) :] for _ in range(12)] + [" ".join(words(50)) for _ in range(10)] + ["", None, texts[0]]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for t in texts)]
    low = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low[i] = low[j] = min(low[i], low[j])
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, row_0 string, n_chars long")
    kept = corpus_pipeline.near_copies(spark, docs, DATA).collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i in range(len(texts)) if low[i] == i]
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in kept}
    times = collections.Counter(t[i : i + 200] for t in raw.values() for i in range(len(t) - 199))
    want = {}
    for k, t in raw.items():
        gone = {j for i in range(len(t) - 199) if times[t[i : i + 200]] > 1 for j in range(i, i + 200)}
        want[k] = bytes(c for j, c in enumerate(t) if j not in gone).decode()
    left = corpus_pipeline.repeats(spark, spark.createDataFrame(kept, docs.schema), DATA)
    assert left.columns == docs.columns
    null = {r["doc_id"] for r in kept if r["text"] is None}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()} == {k: (None, None) if k in null else (t, len(t)) for k, t in want.items()}


@pytest.mark.parametrize("empty", [False, True])
def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch, empty):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path / "shared"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 0" if empty else "doc_id < 40")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = [x for x in os.listdir(tmp_path / "shared" / "chronoweave") if not x.startswith(("placed", "pieces"))]
    assert len(left) == 1 and left[0].startswith("pipeline-packing-")
    assert (out.count() == 0) == empty
