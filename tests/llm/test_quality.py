"""Quality classifier: held-out accuracy, and defined results for awkward rows."""

from pyspark.sql import functions as F

from cellpulse.llm import quality
from llm_frames import awkward, make, nothing, shipped  # noqa: F401

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    got = (quality.classify(docs, labels.where(fold > 0)).withColumnRenamed("quality", "score")
           .join(labels.where(fold == 0), "doc_id").collect())
    bad = [r for r in got if r.quality == 0]
    good = [r for r in got if r.quality == 1 and r.toxic == 0]
    toxic = [r for r in got if r.toxic == 1]
    assert len(bad) > 80 and len(good) > 500 and len(toxic) > 50
    assert sum(not r.keep for r in bad) >= 0.97 * len(bad)
    assert sum(r.keep for r in good) >= 0.97 * len(good)
    assert sum(not r.keep for r in toxic) >= 0.6 * len(toxic)


def test_awkward_rows(spark, awkward):
    for labels in (None, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"),
                   spark.createDataFrame([(7, 1, None), (7, 1, 0), (None, 0, 1), (12, None, None)],
                                         "doc_id bigint, quality int, toxic int")):
        got = quality.classify(awkward, labels).collect()
        assert len(got) == awkward.count()
        assert all(r.keep == (r.quality >= 0.5 and r.clean >= 0.5) for r in got)
        assert not any(r.keep for r in got if r.doc_id in (1, 2, 3))
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns
    want = sorted((r.doc_id for r in quality.classify(awkward).collect() if r.keep), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_same_result_however_the_rows_lie(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, other = ({r.doc_id: (r.quality, r.clean) for r in quality.classify(d).collect()}
                  for d in (docs, docs.repartition(7, "source")))
    assert one == other


def test_labellers():
    def votes(text):
        raw = text.encode()
        s = quality.statistics(raw, raw.split())
        return quality.quality_votes(s), quality.toxicity_votes(s)

    prose = ("The cat sat on the mat and it was happy to be there with the dog, for a long day in the old house had "
             "come to its end and the lamp by the window was not yet out when the rain began to fall on the roof. ")
    assert 0 not in votes(prose)[0] and set(votes(prose)[1]) == {1}
    assert set(votes("der Hund und die Katze sind in dem Haus und das ist gut")[1]) == {-1}
    for junk in (prose.upper(), "word%%% more### and*** " * 20, "Ment " * 60, "a | b | c | d | e " * 10, "go!! now!! yes!! " * 12):
        assert 0 in votes(junk)[0], junk[:20]
    assert 0 in votes("you are a pathetic loser and an idiot")[1]
    assert set(votes("")[0]) == {-1}


def test_repetition_is_bad_at_any_length(spark):
    """One sentence over and over, against the longest good texts of the table."""
    def variety(text):
        return quality.quality_votes(quality.statistics(text.encode(), text.encode().split()))[quality.QUALITY.index("variety")]

    sentence = "The cat sat on the mat and it was happy to be there with the dog. ".split()
    passage = [f"w{i}" for i in range(300)]
    for n in (100, 2_900, 5_000, 20_000):
        assert variety(" ".join((sentence * n)[:n])) == 0
    for n in (2_900, 5_000, 20_000):
        assert variety(" ".join((passage * n)[:n])) == 0
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id").where(F.size(F.split("text", " ")) >= 3000).collect()
    assert len(good) >= 5 and all(variety(r.text) == 1 for r in good)


def test_empty_table(spark, nothing):
    assert quality.classify(nothing).collect() == []
    assert quality.keep_good(nothing).collect() == []
    assert len(make(spark, []).columns) == len(quality.keep_good(nothing).columns)
