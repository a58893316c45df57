"""The stages one after another over a small corpus, held against what each must do to its own input."""

import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from seqspark.llm import queries, shared
from tests.llm.test_repeated_text import removed_plainly
from tests.llm.test_near_texts import jaccard, plain_set
from tests.llm.test_simhash import roots_of


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = say(40)
    good = [say(60) + ("\n" + passage if i % 5 == 0 else "") for i in range(100)]
    good += [good[3], good[4] + " more", good[7]]
    junk = [" ".join(f"word{rnd.randrange(400)}###" for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(good + junk)]
    rows += [(900, None, None, None, None), (901, "", "en", None, 0), (3, good[3], "en", "src0", len(good[3]))]
    base = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    labels = [(i, int(i < 103), 0) for i in range(133) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        inputs.append((docs.collect(), spark.read.parquet(path).collect()))
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    rules, classifier, near, repeats, packed = inputs
    assert ids(rules[1]) == sorted([*range(103), 3])
    assert set(ids(classifier[1])) <= set(ids(classifier[0])) and len(classifier[1]) >= 0.95 * len(classifier[0])
    sets = {r["doc_id"]: plain_set(r["text"]) for r in near[0]}
    root = roots_of(sets, [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8])
    assert set(ids(near[1])) == set(root.values()) and len(near[1]) < len(near[0])
    before = sorted(repeats[0], key=lambda r: r["doc_id"])
    after = {r["doc_id"]: r for r in repeats[1]}
    texts = [r["text"].encode() for r in before]
    for r, text, gone in zip(before, texts, removed_plainly(texts, 100)):
        kept = bytes(b for b, g in zip(text, gone) if not g).decode()
        if after[r["doc_id"]]["text"] != kept:  # a repeated row stands for itself
            assert ids(before).count(r["doc_id"]) > 1
        assert after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in packed[0])
    assert sum(r["length"] for r in packed[1]) == total
    run = corpus_pipeline.run(spark, sf_dir)
    assert run.agg(F.sum("length")).first()[0] == total and run.count() == len(packed[1])


def test_a_stage_deletes_what_earlier_ones_stored(spark, sf_dir, tmp_path):
    def there(path):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpus_pipeline.quality_rules(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/kept")
    other = shared.stored(docs.select("doc_id"), "other")
    left = list(corpus_pipeline._left)
    assert left and all(map(there, left))
    again = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"file://{tmp_path}/kept"), sf_dir)
    assert not any(map(there, left)) and other.count() == docs.count()
    # What a plan still reads stays.
    assert shared.drop(again, list(corpus_pipeline._left)) and again.count() > 0


def test_every_query_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names if n != "pipeline"] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "repeated_text", "packing"]
