"""Op 9: held-out accuracy, the fit on executors against that at hand, and the cases of its docstring."""

import random
import tracemalloc

import pytest

from lexgrove.llm import toxicity

SF = "/root/testdata/sf0.1"


def made(n=240):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    return [(i, " ".join([word() for _ in range(40)] + ["vile"] * ((i % 2) * r.randint(1, 5)))) for i in range(n)]


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda c: f"pmod(crc32(cast(cast({c} as string) as binary)), 4) = 2"
    model = toxicity.fitted(docs, labels.where(f"not {held('doc_id')}"))
    rows = toxicity.severities(docs, model).join(labels.where("toxic is not null").where(held("doc_id")).select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = ([r for r in rows if r.toxic == k] for k in (1, 0))
    assert len(toxic) > 100 and sum(r.rejected for r in toxic) >= 0.9 * len(toxic) and sum(r.rejected for r in clean) <= 0.01 * len(clean)
    # Which of two texts, a toxic and a clean one, is the severer.
    right = sum((a.severity > b.severity) + (a.severity == b.severity) / 2 for a in toxic for b in clean)
    assert right > 0.97 * len(toxic) * len(clean)


def test_fit_on_executors_is_the_fit_at_hand(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model, own = toxicity.fitted(docs, labels), toxicity.fit_ordinal([(t.encode(), i % 2) for i, t in rows])
    assert model.weights.keys() == own.weights.keys() and model.theta == pytest.approx(own.theta)
    assert [model.weights[k] for k in own.weights] == pytest.approx(list(own.weights.values()))
    assert model.theta[0] <= model.theta[1]


def test_cases_of_the_docstring(spark):
    rows = made()
    docs = spark.createDataFrame([*[(i, t, 0.5, "x") for i, t in rows], (900, None, None, None), (901, "", 0.0, ""), (None, "vile vile vile x", 1.0, "y"), (1, rows[1][1], 0.5, "x")], "doc_id long, text string, severity double, toxic string")
    labels = spark.createDataFrame([*[(i, i % 2) for i, _ in rows], (None, 1), (3, None), (12345, 1), (5, 7)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    got = toxicity.severities(docs, model).collect()
    assert len(got) == len(rows) + 4 and got[0].asDict().keys() == {"doc_id", "p_toxic", "p_severe", "severity", "rejected"}
    by = {r.doc_id: r for r in got}
    assert by[900].severity == by[901].severity == 0.0 and by[None].rejected and not by[0].rejected
    kept = toxicity.clean(docs, model)
    assert kept.schema == docs.schema and sorted(map(repr, [r.doc_id for r in kept.collect()])) == sorted(repr(r.doc_id) for r in got if not r.rejected)
    assert toxicity.severities(docs.limit(0), model).collect() == [] and toxicity.clean(docs.limit(0), model).count() == 0
    for some in (labels.where("toxic = 1"), labels.limit(0)):
        assert {r.severity for r in toxicity.severities(docs, toxicity.fitted(docs, some)).collect()} == {0.0}
    assert toxicity.fitted(docs.limit(0), labels) == toxicity.OrdinalModel()


def test_very_long_and_tied_texts():
    rows = [(t.encode(), i % 2) for i, t in made()]
    model = toxicity.fit_ordinal(rows)
    assert model.probabilities(b"vile " * 300_000)[0] > 0.9 and model.probabilities(b"word " * 300_000)[0] < 0.5
    assert len({model.probabilities(rows[3][0]) for _ in range(3)}) == 1


def test_the_driver_holds_little_more_than_the_rows_of_the_fit(spark):
    r = random.Random(5)
    marks = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(100)]
    rows = [(i, " ".join(["plain", *[w for w in marks if r.random() < (0.6 if i % 2 else 0.2)]])) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    tracemalloc.start()
    model = toxicity.fitted(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.weights) >= 390  # nine letters make a word and three prefixes
    assert peak < 2.5 * len(rows) * len(model.weights) * 8
