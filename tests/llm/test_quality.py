import random
import zlib

import numpy as np
import pytest

from cellweave.llm import common, decontaminate, fertility, langid, textstats, weaklabel
from tests.llm import plain

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_rows(spark):
    docs = common.documents(spark, SF)
    got = {x["doc_id"]: x for x in langid.identify(docs, langid.train(docs)).collect()}
    rows = [x for x in docs.collect() if got[x["doc_id"]]["held_out"] and len(x["text"] or "") > 60]
    assert len(rows) > 150
    assert np.mean([got[x["doc_id"]]["lang_pred"] == x["lang"] for x in rows]) > 0.98
    assert np.mean([got[x["doc_id"]]["accepted"] for x in rows]) > 0.99
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_predictions_are_the_plain_ones(spark):
    """Dictionaries of counts, discounts and interpolation for every language, and the least cross-entropy of whole texts."""
    docs = [x for x in common.documents(spark, plain.SF).collect() if len(x["text"] or "") < 2500]
    table = spark.createDataFrame([(x["doc_id"], x["text"], x["lang"]) for x in docs], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.identify(table, langid.train(table)).collect()}
    by = {}
    for x in docs:
        if x["lang"] is not None and x["text"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 != 2:
            by.setdefault(x["lang"], []).append(x["text"])
    models = {x: plain.KneserNey(t) for x, t in sorted(by.items())}
    alphabet = max(2, len({g for m in models.values() for g in m.counts[1]}))
    assert len(models) > 2 and len(docs) > 80
    for x in docs:
        grams = plain.KneserNey.grams(x["text"])
        assert got[x["doc_id"]]["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in x["text"] or ""):
            assert got[x["doc_id"]]["lang_pred"] == "und"
            continue
        seen = {}
        entropy = {}
        for name, m in models.items():
            total = 0
            for g in grams:
                if (name, g) not in seen:
                    seen[name, g] = np.log(m.prob(g, alphabet))
                total -= seen[name, g]
            entropy[name] = total / len(grams)
        best = min(entropy, key=lambda k: (entropy[k], k))
        assert got[x["doc_id"]]["lang_pred"] == best
        assert got[x["doc_id"]]["entropy"] == pytest.approx(entropy[best], rel=1e-3)


def test_probabilities_sum_to_one():
    counts = np.unique(langid.grams(["the cat sat on the mat", "a tab at the mast"])[0], return_counts=True)
    model = langid.Model({"en": counts, "xx": np.unique(langid.grams(["zzz yyy zz"])[0], return_counts=True)})
    letters = sorted({int(g & np.uint64(0xFFFF)) for x in (counts[0], np.unique(langid.grams(["zzz yyy zz"])[0])) for g in x})
    for context in ("the", " ma", "xyz", "qqq"):
        head = 0
        for c in context:
            head = head << 16 | (0 if c == " " else ord(c))
        packed = np.array([head << 16 | c for c in letters], np.uint64)
        assert np.exp(model.log_probs(packed).astype(float)).sum(axis=0) == pytest.approx([1, 1], abs=1e-3)


def test_lookup_finds_every_key():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64))
    table = langid.Hashed(keys[::2], np.arange(len(keys[::2]))[:, None])
    rows, found = table.get(keys)
    assert (found == (np.arange(len(keys)) % 2 == 0)).all() and (rows[found, 0] == np.arange(len(keys[::2]))).all()


def test_no_gram_is_left_out_in_parts(spark):
    """The broadcast parts give what Model gives for all counts at once, and a rare language stays."""
    texts = [(k, plain.prose(k, 80), "en") for k in range(40)] + [(100 + k, "żółw gęś łąka jaźń", "pl") for k in range(3)] + [(200, "漢字仮名交文", "ja"), (201, "", "xx")]
    texts += [(300 + k, t, x) for k, (_, t, x) in enumerate(texts[-2:])]
    texts = [x for x in texts if not langid.held_out(x[0])]
    by = {}
    for _, t, x in texts:
        by.setdefault(x, []).append(t)
    whole = langid.Model({x: tuple(np.unique(langid.grams(t)[0], return_counts=True)) for x, t in by.items()})
    model = langid.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"), part_bytes=2000)
    assert len(model.prob[-1].parts) > 3 and model.languages == whole.languages and {"en", "pl", "ja"} <= set(model.languages)
    packed = langid.grams([t for _, t, _ in texts] + [plain.prose(999, 50), "Ünknown qqzx 漢漢"])[0]
    np.testing.assert_allclose(model.log_probs(packed), whole.log_probs(packed), rtol=1e-5, atol=1e-5)


def test_language_awkward(spark):
    df, rows = plain.awkward(spark)
    who = langid.train(df)
    got = {x["doc_id"]: x for x in langid.identify(df, who).collect()}
    assert {got[i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and got[5]["lang_pred"] == "en" and not got[1]["accepted"]
    assert langid.identify(df, who).count() == len(rows)
    assert langid.keep_accepted(df, who).columns == df.columns
    none = langid.train(df.limit(0))
    assert langid.identify(df.limit(0), none).count() == 0
    assert {x["lang_pred"] for x in langid.identify(df, none).collect()} == {"und"}
    noise = spark.createDataFrame([(1, "qxzj vkqw zzxq jjqk " * 20), (2, plain.prose(77, 50))], "doc_id long, text string")
    trained = langid.Identifier(who.model, langid.Calibration(["en"], [("en", 1.5, 500)] * 30))
    assert [x["accepted"] for x in langid.identify(noise, trained).orderBy("doc_id").collect()][0] is False


def test_no_language_accepts_without_limit(spark):
    rows = [("en", 1.5, 500)] * 30 + [("la", 1.6, 400)] * 3 + [("fi", 2.4, 40)] * 50
    bounds = langid.Calibration(["en", "fi", "la", "xx"], rows)
    assert all(not bounds.accepts(x, 8.0, 1000) for x in bounds.bound)
    assert bounds.accepts("la", 1.6, 400) and bounds.accepts("fi", 2.4, 40) and bounds.accepts("en", 1.5, 500)
    assert all(not langid.Calibration(["en"], some).accepts("en", 1e3, 1000) for some in ([], rows[-3:]))
    many = [(k, plain.prose(k, 40), "en") for k in range(3000)] + [(5000 + k, plain.prose(k, 40), "la") for k in range(25)] + [(6000 + k, "ab cd", "fi") for k in range(30)]
    got = langid.calibration_rows(spark.createDataFrame(many, "doc_id long, text string, lang string"), 200).groupBy("lang").count().collect()
    got = {x["lang"]: x["count"] for x in got}
    assert got["la"] == 25 and got["fi"] == 30 and 100 < got["en"] < 300


def random_text(draw, n):
    return "".join(draw.choice("abcde ") for _ in range(n))


def test_bit_parallel_distance_is_the_plain_one():
    draw = random.Random(0)
    for _ in range(150):
        pattern, text = random_text(draw, draw.randint(1, 80)), random_text(draw, draw.randint(0, 120))
        least = plain.edit_within(pattern, text)
        got = decontaminate.distance_within(pattern, text, len(pattern) - 1)
        assert (got and got[0]) == (least if least < len(pattern) else None)


def test_edited_passages_are_found(spark, monkeypatch):
    draw = random.Random(1)
    items = [(k, plain.prose(k, 25)) for k in range(20)]
    docs, expected = [], set()
    for k in range(60):
        body = plain.prose(5000 + k, 60)
        if k % 3 == 0:
            item, text = draw.choice(items)
            edits = draw.randint(0, int(decontaminate.ERROR_RATE * len(text)))
            chars = list(text)
            for at in sorted(draw.sample(range(len(chars)), edits), reverse=True):
                chars[at : at + 1] = draw.choice([[], ["q"], ["q", chars[at]]])
            body = body[:100] + "\n " + "".join(chars).upper() + " " + body[100:]
            expected.add((k, item))
        docs.append((k, body))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items + [(90, None), (91, "")], "item_id long, text string")
    plainly = {(d, i) for d, t in docs for i, x in items if plain.edit_within(decontaminate.normalise(x), decontaminate.normalise(t)) <= int(decontaminate.ERROR_RATE * len(decontaminate.normalise(x)))}
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contamination(df, bench).collect()}
    assert got == plainly >= expected
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.contamination(df, bench).collect()} == got
    clean = {x["doc_id"] for x in decontaminate.decontaminate(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}


def test_decontamination_awkward(spark):
    df, rows = plain.awkward(spark)
    bench = spark.createDataFrame([(1, dict(rows)[6][:80])], "item_id long, text string")
    hits = [x["doc_id"] for x in decontaminate.contamination(df, bench).collect()]
    assert sorted(hits) == [6, 7, 8, 8]
    assert decontaminate.decontaminate(df, bench).columns == df.columns
    assert decontaminate.decontaminate(df, bench).count() == len(rows) - 4
    assert decontaminate.contamination(df, bench.limit(0)).count() == 0 and decontaminate.decontaminate(df, bench.limit(0)).count() == len(rows)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_base_counts_are_the_plain_ones():
    texts = ["", "a b c d e a b c d e", "x\nx\n\n x\ny # $ <z>", " \n \n", "é ü\r\né ü", "one two three four five six " * 3]
    got = textstats.basics([t.encode() for t in texts])
    for k, t in enumerate(texts):
        w = plain.WORD.findall(t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        again = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if plain.WORD.search(x)]
        assert [int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(again)]


def test_fertility_rejects_what_is_far_outside(spark):
    draw = np.random.default_rng(0)
    rows = [(k, plain.prose(k, 200), "en") for k in range(80)]
    rows += [(100, " ".join("".join(chr(draw.integers(33, 127)) for _ in range(12)) for _ in range(100)), "en"), (101, " | ".join(plain.prose(7, 200).split()), "en")]
    got = {x["doc_id"]: x for x in fertility.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[100]["kept"] and not got[101]["kept"] and not got[100]["base_failed"]
    assert np.mean([got[k]["kept"] for k in range(80)]) > 0.97


def test_window_entropy():
    assert fertility.window_entropy(np.arange(63)) == fertility.window_entropy(np.arange(130)) == pytest.approx(1.0)
    assert fertility.window_entropy(np.zeros(64, np.int64)) == fertility.window_entropy(np.zeros(5, np.int64)) == 0.0
    assert fertility.window_entropy(np.arange(64) % 2) == pytest.approx(1 / 6)
    # the tail counts: 63 tokens of noise after a full window of one token
    assert fertility.window_entropy(np.concatenate((np.zeros(64, np.int64), np.arange(1, 64)))) > 0.4


def test_verdicts_are_the_plain_ones(spark):
    """Measures from the tokenizers' own calls, quartiles by sorting, for every language and script, rare ones too."""
    import math

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = [(x["doc_id"], x["text"], x["lang"]) for x in common.documents(spark, plain.SF).collect()]
    docs += [(10_000 + k, "слово за слово " * (3 + k), None) for k in range(3)] + [(10_010, "漢字 " * 30, "ja"), (10_011, None, None), (10_012, "a", "en")]
    measured, bands = {}, {}
    for i, t, lang in docs:
        t = t or ""
        ids, p = bpe.encode(t, add_special_tokens=False).ids, pieces.encode(t)
        values = [None] * 4
        if len(ids) > 1:
            n = max(1, len(ids) // 64)
            cuts = [k * len(ids) // n for k in range(n + 1)]
            entropy = 0
            for lo, hi in zip(cuts, cuts[1:]):
                w = ids[lo:hi]
                entropy += len(w) * -sum(w.count(x) / len(w) * math.log2(w.count(x) / len(w)) for x in set(w)) / math.log2(len(w)) / len(ids)
            values = [len(t) / len(ids), len(t) / len(p), sum(map(pieces.is_byte, p)) / len(p), entropy]
        measured[i] = (lang or fertility.script(t), len(ids), values)
    for kind in {m[0] for m in measured.values()}:
        rows = [m[2] for m in measured.values() if m[0] == kind and m[1] > 1]
        quartile = lambda k, q, rows=rows: sorted(r[k] for r in rows)[math.ceil(q * len(rows)) - 1]
        bands[kind] = (len(rows), [(quartile(k, 0.25), quartile(k, 0.75)) for k in range(4)]) if rows else None
    verdict = {}
    for i, (kind, n, values) in measured.items():
        inside = True
        for (low, high), v, m in zip(bands[kind][1] if bands[kind] else [], values, fertility.MEASURES):
            reach = fertility.REACH * max(high - low, fertility.LEAST_RANGE[m]) * math.sqrt((1 + 100 / max(n, 1)) * (1 + 20 / bands[kind][0]))
            inside &= v is None or low - reach <= v <= high + reach
        verdict[i] = inside
    got = fertility.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(docs) and any(not x["kept"] and not x["base_failed"] for x in got)
    for x in got:
        assert x["kept"] == (verdict[x["doc_id"]] and not x["base_failed"]), x


def test_fertility_awkward(spark):
    df, rows = plain.awkward(spark)
    got = fertility.quality(df).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == len(rows) and all(by[i]["base_failed"] and not by[i]["kept"] and by[i]["n_words"] == 0 for i in (1, 2, 3))
    assert by[4]["kind"] == "latin" and fertility.quality(df.limit(0)).count() == 0
    assert fertility.script("日本") == "cjk" and fertility.script("12") == "none"


def test_weak_labels_agree_with_labels(spark):
    docs = common.documents(spark, SF)
    got = {x["doc_id"]: x for x in weaklabel.classify(docs, weaklabel.train(docs)).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    kept = {q: np.mean([got[x["doc_id"]]["kept"] for x in labels if x["quality"] == q]) for q in (0, 1)}
    assert kept[0] < 0.1 and kept[1] > 0.97


def test_weak_label_accuracies():
    draw = np.random.default_rng(0)
    n, k = 20000, len(weaklabel.LABELLERS)
    bad = draw.random(n) < 0.2
    chance = np.linspace(0.3, 0.9, k)
    votes = np.where((draw.random((n, k)) < np.where(bad[:, None], chance, 0.01)), -1, 0)
    patterns, counts = np.unique(weaklabel._pattern(votes), return_counts=True)
    model = weaklabel.WeakLabels(patterns, counts)
    assert model.prior == pytest.approx(0.8, abs=0.02)
    assert np.exp(model.table[1, :, 0]) == pytest.approx(chance, abs=0.03)
    assert ((model.posterior(votes) < 0.5) == bad).mean() > 0.99


def test_weak_labels_are_the_plain_ones(spark):
    docs = common.documents(spark, plain.SF)
    got = {x["doc_id"]: x["weak_label"] for x in weaklabel.classify(docs, weaklabel.train(docs)).collect()}
    rows = docs.collect()
    expected = plain.weak_posteriors([plain.votes(x["text"]) for x in rows])
    assert {x["doc_id"] for x in rows} == set(got)
    for x, p in zip(rows, expected):
        assert got[x["doc_id"]] == pytest.approx(p, abs=1e-6), x["doc_id"]


def test_weak_label_awkward(spark):
    df, rows = plain.awkward(spark)
    model = weaklabel.train(df)
    got = weaklabel.classify(df, model).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    assert not any(x["kept"] for x in got if x["doc_id"] in (1, 2, 3))
    assert weaklabel.classify(df.limit(0), weaklabel.train(df.limit(0))).count() == 0


def test_script_is_of_the_whole_text():
    assert fertility.script("MIT License https://example.org/ " * 5 + "съешь же ещё этих мягких булок " * 50) == "cyrillic"
    assert fertility.script("съешь " * 15 + "plain words " * 100) == "latin"
    assert fertility.script("αβγ abc") == "greek" and fertility.script("αβγδ abc") == "greek" and fertility.script("12 !") == "none"


def test_letters_beyond_16_bits_stay_apart():
    from cellweave.llm import langid

    text = "a\U00020000b \U0001D400\U00010400 x\U0001f600"
    letters = text.lower()
    s = langid.symbols(text)
    words = bytes(s.astype("<u2")).decode("utf-16-le", "surrogatepass").split("\0")
    assert [w for w in words if w] == ["a\U00020000b", letters.split()[1], "x"]
    assert langid.grams([text])[2].tolist() == [6]
    every = [c for c in map(chr, range(0x110000)) if c.isalpha() and c.lower() == c]
    assert len({langid.symbols(c).tobytes() for c in every[::37]}) == len(every[::37])


def test_bounds_of_all_training_rows(spark):
    """Rejection bounds follow every training row; a language with few long rows takes its short ones too."""
    many = [(k, plain.prose(k, 40) + " qxzj" * (k % 23 == 0) * 9, "en") for k in range(3200)] + [(5000 + k, plain.prose(k, 3)[:12], "fi") for k in range(60)]
    df = spark.createDataFrame(many, "doc_id long, text string, lang string")
    who = langid.train(df)
    rows = langid._scored(df, langid.Identifier(who.model), "doc_id", "text").where("not held_out and letters > 0").select("lang_pred", "entropy", "letters").collect()
    assert len(rows) > 2200
    whole = langid.Calibration(who.model.languages, [tuple(x) for x in rows], -float(who.model.floor[0]))
    for x in who.model.languages:
        assert abs(who.calibration.bound[x] - whole.bound[x]) < 4 / langid.STEPS and abs(who.calibration.spread[x] - whole.spread[x]) < 1 / langid.STEPS
    draw = np.random.default_rng(0)
    for n in (1, 2, 7, 1000):
        values, times = draw.random(n), draw.integers(1, 5, n)
        for q in (0.5, 0.995, 1.0):
            assert abs(langid.quantile(values, times, q) - np.quantile(np.repeat(values, times), q)) < 1e-12
