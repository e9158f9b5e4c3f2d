import os

import pytest
from pyspark.sql import functions as F

from stackloom.llm import langid as L

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples(spark):
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    return spark.read.parquet(f"{DATA}/lang_samples.parquet")


@pytest.fixture(scope="module")
def model(samples):
    return L.train(samples, "sample_text", "lang")


def test_held_out_accuracy(samples):
    part = F.pmod(F.xxhash64("sample_id"), F.lit(5)) == 0
    fitted = L.train(samples.filter(~part), "sample_text", "lang")
    rows = samples.filter(part).collect()
    best = fitted.score([L.evidence(" ".join(s for _, _, s in L.sentences(r["sample_text"]))) for r in rows]).argmax(axis=1)
    right = sum(fitted.languages[b] == r["lang"] for b, r in zip(best, rows))
    assert len(rows) > 30 and right / len(rows) >= 0.95


def test_mixed_documents_and_code(spark, model):
    texts = [
        (1, "The numbers look fine to me, so let us close this and move on. Die Zahlen sehen für mich gut aus, also schließen wir das ab."),
        (2, '  File "/app/src/a.py", line 5, in x.y\n#3 0x1f2e core.run_all'),
        (3, None), (4, ""), (5, "   \n "), (6, "a" * 200_000), (7, "LES CHIFFRES ME SEMBLENT BONS, ALORS FERMONS CE SUJET."),
        (8, "есть ли причина читать всю таблицу целиком? `x.y()` 这个问题应该不严重,因为会话存储每天只运行56次。"),
    ]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("prose", F.lit("clash"))
    got = {r["doc_id"]: r for r in L.segments(df, model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de"] and all(s["confidence"] > 0.9 for s in got[1]["spans"])
    assert texts[0][1][got[1]["spans"][1]["start"] :].strip().startswith("Die Zahlen")
    assert all(not got[i]["spans"] for i in (2, 3, 4, 5)) and len(got) == 8
    assert [s["lang"] for s in got[7]["spans"]] == ["fr"] and [s["lang"] for s in got[8]["spans"]] == ["ru", "zh"]
    langs = {(r["doc_id"], r["lang"]) for r in L.document_languages(L.segments(df, model)).collect()}
    assert {(1, "en"), (1, "de"), (7, "fr"), (8, "ru"), (8, "zh")} <= langs
    assert L.segments(df.limit(0), model).collect() == []


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "en-US": "en", "en_GB": "en", "English": "en", "eng": "en", " de ": "de", "ger": "de", "Deutsch": "de", "zh-CN": "zh", "zh_Hans": "zh", "und": None, "": None, None: None, "n/a": None, "-": None, "mul": None, "Portuguese (Brazil)": "pt", "pl": "pl", "sv-SE": "sv", "unknown": None, "??": None, "null": None}
    df = spark.createDataFrame([(k,) for k in cases], "label string")
    assert {r[0]: r[1] for r in df.select("label", L.iso_code(F.col("label"))).collect()} == cases


def test_a_language_beyond_the_table_is_fitted_and_its_label_is_right(spark):
    polish = ["Nie ma powodu, żeby czytać całą tabelę.", "Proszę przenieść to zapytanie poza pętlę.", "Liczby wyglądają dobrze, więc zamykamy sprawę."]
    rows = [(t, "pl") for t in polish] + [("There is no reason to read the whole table.", "en"), ("The numbers look fine, so we close this.", "en"), ("Please move this query out of the loop.", "en"), ("ohne Sprache", "und")]
    fitted = L.train(spark.createDataFrame(rows, "t string, l string"), "t", "l")
    assert fitted.languages == ["en", "pl"]
    assert [fitted.languages[i] for i in fitted.score(["nie ma powodu czytać tabelę", "no reason to read this table"]).argmax(axis=1)] == ["pl", "en"]


def test_what_no_language_has_seen_decides_nothing(spark):
    """Totals differ by a factor of twenty, yet unseen text has equal odds."""
    rows = [(f"word{i} alpha beta gamma delta", "en") for i in range(40)] + [("eins zwei drei", "de"), ("vier", "de")]
    fitted = L.train(spark.createDataFrame(rows, "t string, l string"), "t", "l")
    got = fitted.score(["ψχωϞϟϠ"])
    assert abs(got[0, 0] - got[0, 1]) < 1e-6


def test_names_in_another_script_and_compounds():
    assert L.evidence("到了第60分钟,media store的错误突然变多").split() == ["到了第", "分钟", "的错误突然变多"] or "media" not in L.evidence("到了第60分钟,media store的错误突然变多")
    assert "mail-relay" not in L.evidence("nothing was lost in mail-relay today") and L.evidence("mail-relay") == "mail-relay"
    assert [s for _, _, s in L.sentences("a well-known state-of-the-art method")] == ["a well-known state-of-the-art method"]
    for code in ("checkout.views.QueueReader.parse", "BatchPlan", "flush_window", "_private", "a/b/c.py", "RowLoader.flush()", "`x y`", "https://a.b/c", "x=1"):
        assert L.blank_code(f"see {code} now").split() in (["see", "now"], ["see", "()", "now"]), code
    assert L.blank_code("Überschrift größer ÉTÉ") == "Überschrift größer ÉTÉ"


def test_long_runs_stay_linear():
    import time

    began = time.perf_counter()
    for text in ("a" * 300_000, "aB" * 150_000, "a-" * 150_000, "./" * 150_000, "A" * 300_000, "_" * 300_000, "a.b" * 100_000, "字" * 300_000, "1," * 150_000):
        for _, _, s in L.sentences(text):
            L.evidence(s)
    assert time.perf_counter() - began < 20
