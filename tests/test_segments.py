"""The segmented index against one that is built anew; publishing, merging, plans."""

import random

import pytest
from pyspark.sql import functions as F

from notelake.operators import bm25, index, segments
from notelake.operators.segments import SegmentIndex

SCHEMA = "id long, title string, content string, project string"
WORDS = "migrating cache tokens tokenized index relation erased nothing búsqueda".split()


def note(rng, i):
    return (i, " ".join(rng.choices(WORDS, k=rng.randint(0, 4))) or None, " ".join(rng.choices(WORDS, k=rng.randint(0, 12))), rng.choice(["alpha", None]))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def same(spark, got, notes):
    want = index.build(frame(spark, list(notes.values())), stemmed=got.stemmed)
    rows = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()))
    assert rows(got.postings, "doc_id", "col", "pos", "term") == rows(want.postings, "doc_id", "col", "pos", "term")
    assert rows(got.docstats, "doc_id", "n_tokens") == rows(want.docstats, "doc_id", "n_tokens")
    a, b = got.totals().first(), want.totals().first()
    assert (a["n_docs"], a["avgdl"]) == (b["n_docs"], pytest.approx(b["avgdl"]))
    scores = lambda i: {r["doc_id"]: pytest.approx(r["score"]) for r in bm25.match_any(i, "migrate cache").collect()}
    assert scores(got) == scores(want)


@pytest.mark.parametrize(("seed", "stemmed"), [(1, False), (2, True)])
def test_writes_equal_a_rebuilt_index(spark, tmp_path, monkeypatch, seed, stemmed):
    monkeypatch.setattr(segments, "FAN", 3)
    monkeypatch.setattr(segments, "CLASS_POSTINGS", 30)
    rng = random.Random(seed)
    notes = {i: note(rng, i) for i in range(20)}
    at = SegmentIndex.create(frame(spark, list(notes.values())), f"{tmp_path}/i", stemmed=stemmed)
    same(spark, at, notes)
    for step in range(6):
        changed = {i: note(rng, i) for i in [*rng.sample(sorted(notes), 2), 100 + step]}
        gone = rng.sample([i for i in notes if i not in changed], 2) + [9999]
        notes = {i: n for i, n in (notes | changed).items() if i not in gone}
        at = at.add(frame(spark, list(changed.values())), frame(spark, [(i, None, None, None) for i in gone]))
        if step % 2:
            same(spark, at, notes)
    assert len(at.segments) < 6
    at = at.add(removed=frame(spark, [(i, None, None, None) for i in notes]))
    assert at.live == (0, 0) and at.postings.isEmpty()


def test_publishing_is_all_or_nothing_and_old_readers_stay(spark, tmp_path):
    rng = random.Random(4)
    notes = {i: note(rng, i) for i in range(8)}
    root = f"{tmp_path}/i"
    first = SegmentIndex.create(frame(spark, list(notes.values())), root).publish()
    one, two = (first.add(frame(spark, [note(rng, 50 + k)])) for k in (1, 2))
    assert SegmentIndex.open(spark, root).segments == first.segments  # nothing is seen before it is published
    one = one.publish()
    with pytest.raises(ValueError, match="another writer"):
        two.publish()
    now = SegmentIndex.open(spark, root)
    assert now.segments == one.segments and now.live[0] == 9
    assert SegmentIndex.open(spark, root, 1).docstats.count() == 8
    assert now.vacuum() == 1  # the loser's
    same(spark, SegmentIndex.open(spark, root), notes | {51: _stored(one, 51)})
    with pytest.raises(ValueError, match="no published index"):
        SegmentIndex.open(spark, root, 1)


def _stored(at, i):
    """A note that has the words of an indexed one."""
    words = at.postings.where(F.col("doc_id") == i).orderBy("col", "pos").collect()
    text = lambda c: " ".join(w["term"] for w in words if w["col"] == c) or None
    return (i, text("title"), text("content"), text("project"))


def test_an_added_note_reads_neither_the_table_nor_old_postings(spark, tmp_path):
    rng = random.Random(5)
    frame(spark, [note(rng, i) for i in range(200)]).write.parquet(f"{tmp_path}/observations")
    rows = spark.read.parquet(f"{tmp_path}/observations")
    at = SegmentIndex.create(rows, f"{tmp_path}/i")
    seen = []
    real = SegmentIndex._segment

    def spy(self, seg, new, removed):
        seen.extend(df._jdf.queryExecution().executedPlan().toString() for df in (new.postings, new.docstats, removed))
        return real(self, seg, new, removed)

    SegmentIndex._segment = spy
    try:
        after = at.add(frame(spark, [note(rng, 500)]))
    finally:
        SegmentIndex._segment = real
    assert len(seen) == 3 and not any("observations" in p or "/postings" in p for p in seen)
    assert "GreaterThanOrEqual(doc_id,500)" in seen[2]  # the statistics of its id only
    assert len(after.segments) == 2 and after.segments[1].n_postings < 30
    plan = bm25.postings_of(after, bm25.phrases({0: ["cache"]}))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,cache)" in plan
