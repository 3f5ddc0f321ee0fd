"""The pipeline against plain versions of its stages, on the smallest documents."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from cellweave.llm import common, decontaminate, queries, simhash, tokens
from tests.llm import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each but the last, and the result."""
    docs, out = common.documents(spark, plain.SF), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.store(stage(spark, docs, plain.SF), name.replace(" ", "-").lower())
        out.append(docs)
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, plain.SF)


def texts(df):
    return {x["doc_id"]: x["text"] for x in df.collect()}


def test_columns_stay(stages):
    for df in stages[0]:
        assert df.columns == COLUMNS


def test_language_stage_keeps_prose(stages):
    before, after = texts(stages[0][0]), texts(stages[0][1])
    assert set(after) <= set(before) and len(after) >= 0.98 * len(before)


def test_one_of_each_near_copy_stays(stages):
    before, after = texts(stages[0][1]), texts(stages[0][2])
    fps = {i: plain.fingerprint(t, 5) for i, t in before.items()}
    more = {i: [plain.fingerprint(t, 5, k) for k in range(1, simhash.LONG + 1)] for i, t in before.items()}
    comp = plain.components(fps, 20, more, simhash.bits_apart(0.8, 1024))
    assert after == {i: t for i, t in before.items() if comp[i] == i}


def test_repeated_passages_go_but_for_the_first(stages):
    before, after = texts(stages[0][2]), texts(stages[0][3])
    words = lambda t: plain.WORD.findall(t)
    expected = dict(plain.cut_words(list(before.items()), 50, True))
    assert {i: words(t) for i, t in after.items()} == {i: w for i, w in expected.items() if w}
    assert all(t == before[i] for i, t in after.items() if expected[i] == words(before[i]))
    assert all(x["n_chars"] == len(x["text"]) for x in stages[0][3].collect())


def test_benchmark_passages_go(spark, stages):
    before, after = texts(stages[0][3]), texts(stages[0][4])
    items = [decontaminate.normalise(x["text"]) for x in spark.read.parquet(f"{plain.SF}/benchmark.parquet").collect()]
    hit = {i for i, t in before.items() if any(x in decontaminate.normalise(t) for x in items)}
    assert hit and not hit & set(after)
    assert set(before) - set(after) == hit


def test_packing_covers_the_rest(stages):
    docs, packed = texts(stages[0][4]), stages[1].collect()
    seen = {}
    for x in packed:
        seen.setdefault(x["doc_id"], []).append((x["start"], x["length"], x["ids_crc32"]))
    assert set(seen) == set(docs)
    for i, t in docs.items():
        ids, at = tokens.token_ids(t, tokens.vocabulary("byte_bpe_50k.tiktoken"), 1), 0
        for start, n, crc in sorted(seen[i]):
            assert start == at and crc == zlib.crc32(np.ascontiguousarray(ids[start : start + n]).tobytes())
            at += n
        assert at == len(ids)


def test_run_gives_the_stages_result(spark, stages):
    """Every token of the same documents once; where pieces lie depends on how rows were dealt to tasks."""

    def tokens_of(df):
        out = {}
        for x in df.collect():
            out.setdefault((x["doc_id"], x["doc_tokens"]), []).append((x["start"], x["length"]))
        return {k: sum(n for _, n in v) for k, v in out.items() if sorted(v)[0][0] == 0}

    ours = tokens_of(corpus_pipeline.run(spark, plain.SF))
    assert ours == tokens_of(stages[1]) and all(total == n for (_, total), n in ours.items())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("number", range(5))
def test_stages_on_awkward_rows(spark, number):
    df, _ = plain.awkward(spark)
    stage = corpus_pipeline.STAGES[number][1]
    out = stage(spark, df, plain.SF)
    assert out.count() > 0 and (number == 4 or out.columns == df.columns)
    assert stage(spark, df.limit(0), plain.SF).count() == 0
