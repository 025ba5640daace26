"""Searches by index against scans of the texts."""

import math
import re
import unicodedata

import numpy as np
import pytest

from threadloom.operators import index

#: Examples of the paper that describes the steps.
STEMS = dict(x.split(":") for x in "caresses:caress ponies:poni ties:ti feed:feed agreed:agre plastered:plaster sing:sing conflated:conflat troubled:troubl hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit decisiveness:decis sensibiliti:sensibl triplicate:triplic formalize:formal electrical:electr goodness:good revival:reviv adjustable:adjust replacement:replac adoption:adopt homologous:homolog probate:probat rate:rate cease:ceas controll:control roll:roll levies:levi levy:levi a:a is:is naïve:naïve x9ing:x9ing".split())
FORMS = ["levy", "levies", "confirm", "confirming", "Confirmed", "café", "CAFE", "cinv", "00066864", "hop", "hopping", "the", "of"]


def test_stems():
    assert {w: index.stem(w) for w in STEMS} == STEMS
    assert index.index_words("Confirming the Ñandú_x CINV-00066864") == ["confirm", "the", "nandu", "x", "cinv", "00066864"]
    assert index.index_words(None) == [] == index.index_words("— !")


def rows():
    r = np.random.default_rng(1)
    some = lambda n: " ".join(FORMS[i] for i in r.integers(0, len(FORMS), n))
    out = [(i, some(int(r.integers(0, 4))), some(int(r.integers(0, 30)))) for i in range(200)]
    return out + [(900, None, None), (901, "", "Confirming the levy on invoice CINV-00066864 today"), (902, "x", "aaaa AAA aa"), (903, "the levy", "the " * 3000 + "levy of"), (904, "of", "the"), (905, None, "100% (a+b) 100%")]


def scanned(all_rows, terms, stemmed, weights):
    def words(t):
        t = "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if unicodedata.category(c) != "Mn")
        return [index.stem(w) if stemmed else w for w in re.findall(r"[^\W_]+", t)]

    read = {i: [words(x) for x in texts] for i, *texts in all_rows}
    n, avg = len(read), sum(len(w) for x in read.values() for w in x) / len(read)
    out = {}
    for t in terms:
        p = words(t)
        tf = {i: sum(g * sum(w[k : k + len(p)] == p for k in range(len(w))) for g, w in zip(weights, x)) for i, x in read.items()}
        tf = {i: v for i, v in tf.items() if v}
        idf = max(math.log((n - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6) if tf else 0
        one = {i: idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * sum(map(len, read[i])) / avg)) for i, v in tf.items()}
        out = one if t == terms[0] else {i: out[i] + v for i, v in one.items() if i in out}
    return out


@pytest.mark.parametrize("stemmed", [True, False])
def test_words_and_phrases(spark, tmp_path, stemmed):
    df = spark.createDataFrame([(*r, "x") for r in rows()], "entry_id long, subject string, body string, token string").repartition(3)
    path = f"file://{tmp_path}/words"
    index.write_index(df, path, ("subject", "body"), buckets=8, stemmed=stemmed)
    for terms in (["confirm"], ["levy", "café"], ["the levy"], ["of the", "hop"], ["confirming the levy on"], ["CINV-00066864"], ["the the the"], ["nowhere"]):
        got = {r["entry_id"]: r["score"] for r in index.match(spark, path, terms, {"subject": 4.0}).collect()}
        want = scanned(rows(), terms, stemmed, (4.0, 1.0))
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want), terms
    for none in ([], ["—"], ["levy", "!"]):
        assert index.match(spark, path, none).count() == 0


def test_substrings(spark, tmp_path):
    all_rows = [(i, t) for i, _, t in rows()]
    df = spark.createDataFrame(all_rows, "entry_id long, text string").repartition(3)
    path = f"file://{tmp_path}/grams"
    index.write_grams(df, path, buckets=8)
    n, avg = len(all_rows), sum(max(len(t or "") - 2, 0) for _, t in all_rows) / len(all_rows)
    for needle in ("00066864", "cinv-0006", "AAA", "aa", "100%", "(a+b)", "AFÉ", "the levy", "nowhere"):
        low = needle.lower()
        tf = {i: sum((t or "").lower().startswith(low, k) for k in range(len(t or ""))) for i, t in all_rows}
        tf = {i: v for i, v in tf.items() if v and len(low) >= 3}
        idf = max(math.log((n - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6)
        size = dict(all_rows)
        want = {i: idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * (len(size[i]) - 2) / avg)) for i, v in tf.items()}
        got = {r["entry_id"]: r["score"] for r in index.holding(df, path, needle).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want), needle


def test_rows_of_an_index_are_tokens_of_blocks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"the levy of {i % 10}") for i in range(1000)], "entry_id long, text string").coalesce(1)
    index.write_index(df, f"file://{tmp_path}/w", ("text",))
    index.write_grams(df, f"file://{tmp_path}/g")
    # 13 words and 20 trigrams, not 4 and 11 for each of 1,000 texts
    assert spark.read.parquet(f"file://{tmp_path}/w/postings").where("token IS NOT NULL").count() == 13
    assert spark.read.parquet(f"file://{tmp_path}/g/grams").count() == 20
    assert index.match(spark, f"file://{tmp_path}/w", ["levy of"]).count() == 1000 == index.holding(df, f"file://{tmp_path}/g", "levy").count()


def test_empty_and_expressions(spark, tmp_path):
    none = spark.createDataFrame([], "entry_id long, text string")
    index.write_index(none, f"file://{tmp_path}/w", ("text",))
    index.write_grams(none, f"file://{tmp_path}/g")
    assert index.match(spark, f"file://{tmp_path}/w", ["levy"]).count() == 0 and index.holding(none, f"file://{tmp_path}/g", "levy").count() == 0
    assert index.expressions('levy CINV-00066864, "the levy" 7') == (["levy", "CINV-00066864", "the levy", "7"], ["CINV-00066864"])
