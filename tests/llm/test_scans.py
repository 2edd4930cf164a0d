"""Language, toxicity, secrets and WARC on small cases."""

import gzip
import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandlake.llm import langid, secrets, toxicity, warc

SYLLABLES = {"en": "the ing er on an re tion of and", "de": "der ung sch ein keit und ver pf", "fr": "le eau eux oi ment qu re de"}


def prose(lang, n, rng):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(n))


def test_language(make_docs, odd_texts):
    rng = random.Random(1)
    langs = ["en", "de", "fr"] * 30
    model = langid.train(make_docs([prose(x, 80, rng) for x in langs], langs=langs))
    got = langid.identify(make_docs([prose(x, 60, rng) for x in langs] + odd_texts), model).collect()
    got.sort(key=lambda r: r.doc_id)
    assert sum(r.lang_pred == x for r, x in zip(got, langs)) >= 88 and not any(r.rejected for r in got[:90])
    assert all(0 <= r.score <= 1 for r in got)
    rest = got[90:]
    assert [r.lang_pred for r in rest[:3]] == ["und"] * 3 and rest[0].rejected
    assert all(r.lang_pred in SYLLABLES for r in rest[3:10]) and rest[7].lang_pred == rest[8].lang_pred
    nothing = langid.train(make_docs([None, ""], langs=[None, "en"]))
    assert langid.identify(make_docs(["some words"]), nothing).first().lang_pred == "und"
    assert langid.identify(make_docs([]), model).count() == 0


@pytest.fixture
def labelled(spark, make_docs):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        texts.append(prose("en", 40, rng) + (" moron " + rng.choice(["badword", "badwords"]) if bad else ""))
        labels.append((i, int(bad)))
    return make_docs(texts), spark.createDataFrame([*labels, (5000, 1), (3, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity(labelled, make_docs, odd_texts):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    rng = random.Random(3)
    got = {r.doc_id: r for r in toxicity.score(make_docs([prose("en", 30, rng) + " a moron badword", prose("en", 30, rng), *odd_texts]), model).collect()}
    assert got[0].predicted == 1 and got[0].evidence and got[1].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(got[k].score == got[2].score for k in range(2, 14))
    one_class = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, one_class).where("score <> 0").count() == 0
    assert toxicity.score(docs.where("false"), model).count() == 0
    assert toxicity.train(docs.where("false"), labels).base == 0.5


def test_block_max_search_is_exact():
    rng = random.Random(4)
    vectors = []
    for _ in range(700):
        v = {f: rng.random() for f in rng.sample(range(30), rng.randint(1, 6))}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({f: x / norm for f, x in v.items()})
    index = toxicity.BlockMaxIndex.build(list(range(700)), [i % 2 for i in range(700)], vectors, 30)
    for q in vectors[:60]:
        found, near = index.search(q, 25)
        want = sorted((sum(w * vectors[i].get(f, 0) for f, w in q.items()) for i in range(700)), reverse=True)[:25]
        assert [round(float(x), 9) for x in near] == [round(min(1.0, x), 9) for x in want if x > 0]


BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def test_secret_rules_and_model(make_docs, odd_texts):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    teach = [f"{prose('en', 20, rng)} token = \"{key(40)}\" {prose('en', 20, rng)} some_ordinary_name" for _ in range(60)]
    texts = teach + odd_texts + ["PASSWORD: 'abc' passwd=abcdef1 ſecret=abcdefg", "AKIA" + "A" * 15, "xAKIAAKIA" + "B" * 16, "0123456789abcdef0123456789abcdef token=0123456789abcdef01234567", f"see {key(44)} here", "plain_words_with_underscores_only_2024"]
    docs = make_docs(texts)
    got = sorted(secrets.scan(docs, secrets.train(docs)).collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, texts, strict=True):
        want = sorted((m.start(), k, m.end(), name) for k, (name, rule, ok) in enumerate(BASE) for m in rule.finditer(t or "") if ok(m))
        listed = ",".join(f"{n}:{a}:{b}" for a, _, b, n in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(filter(None, r.spans.split(",")))
    assert got[-2].n_random == 1 and got[-1].n_random == 0 and got[0].n_random == 0
    clean = {r.doc_id: r.text for r in secrets.redact(docs, secrets.train(docs)).collect()}
    assert clean[60] is None and clean[67] == "same text here" and "[REDACTED]" in clean[0] and "token = " not in clean[0]
    assert secrets.scan(docs.where("false"), secrets.train(docs.where("false"))).count() == 0


def test_every_long_run_is_judged(make_docs):
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    key = lambda n, of=letters + "0123456789": "".join(rng.choices(of, k=n))
    docs = make_docs([f"{prose('en', 20, rng)} token = \"{key(40)}\" {prose('en', 20, rng)} some_ordinary_name" for _ in range(60)])
    model = secrets.train(docs)
    found = [key(513), key(5000), key(100, letters) + "7" + key(20), key(48, letters)]
    ordinary = ["-" * 30, "the".join(["ing"] * 300), "=" * 600]
    rows = make_docs([f"see {t} here" for t in found + ordinary])
    got = [r.n_random for r in sorted(secrets.scan(rows, model).collect(), key=lambda r: r.doc_id)]
    assert got == [1] * len(found) + [0] * len(ordinary)
    clean = [r.text for r in sorted(secrets.redact(rows, model).collect(), key=lambda r: r.doc_id)]
    assert clean[: len(found)] == ["see [REDACTED] here"] * len(found)
    assert clean[len(found) :] == [f"see {t} here" for t in ordinary]


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>" + "ö" * 600, "<p>small"
    rows = [(1, "http://a/\r\nx", big), (5, "http://b/", big), (3, None, big), (2, "u", small), (4, "u", small), (7, "u", None), (8, "u", "WARC/1.1\r\n\r\nX-Page: 9\r\n\r\n" * 60), (5, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(warc.with_revisits(pages), f"file://{tmp_path}/w", sizes=((1000, 4), (1300, 3), (None, 3)))
    assert len(list(tmp_path.glob("w/size-*"))) == 3
    found = warc.read(spark, f"file://{tmp_path}/w")
    assert found.count() == 24
    got = sorted((r.request.page_id, r.response.record_type, r.response.refers_to_page, r.response.http_length) for r in warc.assemble(found).collect())
    n = len(big.encode())
    assert got == [(1, "revisit", 5, n), (2, "response", None, 8), (3, "revisit", 5, n), (4, "response", None, 8), (5, "response", None, n), (5, "response", None, n), (7, "response", None, 0), (8, "response", None, 25 * 60)]
    warc.write(warc.with_revisits(pages.where("false")), f"file://{tmp_path}/none")
    assert warc.assemble(warc.read(spark, f"file://{tmp_path}/none")).count() == 0
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")))


def test_keys_beside_other_letters_and_spans_are_judged(make_docs):
    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    teach = [f"token={key(40)} and the configuration_value of some ordinary sentence" for _ in range(40)]
    k = key(40)
    spots = [f"clé={k}", f"é{k}", f"密钥{k}", f"密钥:{k}ключ", f"Q{'0123456789ab' * 2}Z{k}", f"AKIA{'A1B2' * 4}_{k}", f"{k}_AKIA{'A1B2' * 4}", f"{k}/{'0123456789ab' * 2}/{k}"]
    clean = ["développement électronique Übergrößenträger straßenverkehrsordnung", "密钥 значение_конфигурации español_corazón", "é" * 5_000, "naïve-configuration_values"]
    docs = make_docs(teach + spots + clean)
    model = secrets.train(docs)
    got = sorted(secrets.scan(docs, model).collect(), key=lambda r: r.doc_id)[len(teach) :]
    assert [r.n_random for r in got] == [1] * 7 + [2] + [0] * len(clean)
    plain = sorted(secrets.redact(docs, model).collect(), key=lambda r: r.doc_id)[len(teach) :]
    assert not any(k in r.text for r in plain[: len(spots)])
    assert [r.text for r in plain[len(spots) :]] == clean
    assert plain[2].text == "密钥[REDACTED]"


def test_examples_are_bounded_by_rows_not_ids(labelled, make_docs):
    """An id that repeats with many texts, or one, doesn't exceed the bound; rows of equal id and text are one example."""
    docs, labels = labelled
    again = docs.unionByName(docs).unionByName(docs.where("doc_id = 0").crossJoin(docs.select(F.col("text").alias("t"))).withColumn("text", F.concat("text", F.lit(" "), "t")).drop("t"))
    whole = toxicity.train(docs, labels)
    assert sorted(toxicity.train(docs.unionByName(docs), labels).index.ids) == sorted(whole.index.ids)
    few = toxicity.train(again, labels, max_examples=30)
    assert few.index is None or len(few.index.ids) <= 30


def test_caught_share_on_held_out_rows(spark):
    """On the driver's tables, most toxic texts that were held out are found, and next to no other."""
    data = Path("/root/testdata/sf0.01")
    if not data.exists():
        pytest.skip("the driver's tables are not here")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs.select("doc_id", "text"), labels.where(~held)))
    told = found.join(labels.where(held), "doc_id").groupBy("toxic").agg(F.sum("predicted").alias("hit"), F.count("*").alias("n")).collect()
    share = {r.toxic: r.hit / r.n for r in told}
    assert share[1] >= 0.5 and share[0] <= 0.02
