import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from netsift.llm.bpe import default_path
from netsift.llm.pii import KEY, pseudonymise
from tests.llm.test_mixing import brute as mix_brute
from tests.llm.test_ngram_join import brute as join_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.conf.set(KEY, "netsift")
    out = [docs]
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stage_names_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "pii", "mixture", "tokens"] and cp.ORACLE_SQL is None
    assert all(s.columns == steps[0].columns for s in steps[:5])


def test_toxicity_keeps_rows_as_they_are(spark, steps):
    before, after = set(map(tuple, steps[0].collect())), set(map(tuple, steps[1].collect()))
    assert after < before and len(after) > len(before) / 2
    toxic, clean = ({r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where(f"toxic = {v}").collect()} for v in (1, 0))
    gone = {r[0] for r in before - after}  # ten toxic documents to learn from: far from what larger tables give (test_models.py)
    assert len(toxic & gone) / len(toxic) > 3 * len(clean & gone) / len(clean)


def test_near_duplicates_keep_one(steps):
    want = sorted(d for d, _, c in join_brute(rows(steps[1]), 5, 80, 100) if d == c)
    assert sorted(r["doc_id"] for r in steps[2].select("doc_id").collect()) == want


def test_pii_can_be_inverted(steps):
    before = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    after = {r["doc_id"]: r for r in steps[3].collect()}
    assert before.keys() == after.keys() and any(before[k] != after[k]["text"] for k in before)
    assert {r["doc_id"]: r["text"] for r in pseudonymise(steps[3], "netsift", invert=True).collect()} == before
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_mixture_takes_what_the_mix_says(steps):
    want = {i: t // n for i, n, _, _, t in mix_brute(rows(steps[3])) if n}
    got = {r["doc_id"]: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_tokens_are_the_library_s(steps):
    library = Tokenizer.from_file(default_path())
    texts = dict((i, t) for i, t, _ in rows(steps[4]))
    got = steps[5].collect()
    assert len(got) == steps[4].count()
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_empty_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label int"
    odd = spark.createDataFrame([(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (None, "a b", "en", "s", 3, 1), (3, "a " * 9000, "en", "t", 18000, 1), (3, "a " * 9000, "en", "t", 18000, 1)], schema)
    for df in (odd, odd.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, df, SF)
            assert name == "tokens" or out.columns == df.columns
            out.collect()


def test_clashing_columns_stay(spark):
    names = ["__score", "__toxic", "__found", "__new", "__source", "__whole", "__end", "__size", "__copies", "row", "copy", "h", "mark", "__id", "__stays", "node", "score"]
    df = spark.createDataFrame([(1, "mail a@b.org twice", "en", "s", 18, *range(len(names))), (2, None, "en", None, 0, *range(len(names)))], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        assert {tuple(r)[5:] for r in out.collect()} <= {tuple(range(len(names)))}


def test_run_leaves_only_its_last_stage(spark):
    import os

    folder = cp.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {x for x in os.listdir(folder) if x.startswith("corpus-")}
    assert cp.run(spark, SF).count() > 0
    (new,) = {x for x in os.listdir(folder) if x.startswith("corpus-")} - before
    assert os.listdir(f"{folder}/{new}") == ["tokens"]
