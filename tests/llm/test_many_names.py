"""However many names and addresses meet, each has a surrogate of its own that nobody really has; mentions of one person agree."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from watchplan.llm import pii

KEY = b"a test's own key"


def _replaced(spark, texts):
    return pii.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY)


def _surrogates(spark, texts):
    return [(r["begin"], r["surrogate"]) for r in _replaced(spark, texts).select("doc_id", F.explode("entities").alias("e")).select("e.*").collect()]


def _in_texts(mentions, size=200):
    return [" and ".join(mentions[k : k + size]) for k in range(0, len(mentions), size)]


def test_more_names_than_three_syllables(spark):
    names = ["X" + "".join(c) for c in itertools.islice(itertools.product("abcdefghijklmnopqr", repeat=3), 5000)]
    got = [s for _, s in _surrogates(spark, _in_texts([f"Mr {n}" for n in names]))]
    assert len(got) == len(set(got)) == 5000 and not set(got) & set(names)


def test_a_hundred_thousand_names_by_sql(spark):
    """Given and family names together, and the spellings of surrogates among the real ones."""
    letters = "bcdfglmnprst"
    family = ["".join(c).capitalize() for c in itertools.islice(itertools.product(letters, "aeiou", letters, "aeiou", letters, "ae"), 50_000)]
    given = [n + "el" for n in family]
    own = [pii.Surrogates(KEY)("family", "weber").capitalize(), "Weber", *pii.FIRST["latin", "f"]]
    texts = _in_texts([f"Mrs {a} {b}" for a, b in zip(given, family, strict=True)] + [f"Mrs {n}" for n in own])
    out = _replaced(spark, texts).cache()
    rows = out.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")
    source = spark.createDataFrame(list(enumerate(texts)), "doc_id long, source string")
    rows.join(source, "doc_id").selectExpr("substring(source, begin + 1, `end` - begin) AS mention", "surrogate").createOrReplaceTempView("mentions")
    spark.sql("SELECT DISTINCT explode(split(mention, ' ')) AS word FROM mentions").createOrReplaceTempView("real_words")
    assert spark.sql("SELECT surrogate FROM mentions GROUP BY surrogate HAVING count(DISTINCT mention) > 1").count() == 0
    assert spark.sql("SELECT mention FROM mentions GROUP BY mention HAVING count(DISTINCT surrogate) > 1").count() == 0
    assert spark.sql("SELECT * FROM (SELECT explode(split(surrogate, ' ')) AS word FROM mentions) JOIN real_words USING (word)").count() == 0
    assert spark.sql("SELECT DISTINCT mention FROM mentions").count() == 50_000 + len(own)
    out.unpersist()


@pytest.mark.parametrize("real", [[f"10.20.{a}.{b}" for a in range(256) for b in range(256)], [f"{k // 1000}.{k // 100 % 10}.{k // 10 % 10}.{k % 10}" for k in range(10_000) if k % 5]], ids=["slash16", "one digit"])
def test_dense_addresses(spark, real):
    got = [s for _, s in _surrogates(spark, _in_texts(real))]
    assert len(got) == len(set(got)) == len(real) and not set(got) & set(real)
    assert all(re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", s) and all(int(p) < 256 for p in s.split(".")) for s in got)


def test_used_up_forms_and_error(spark):
    """E-mails of letters that no alphabet here has can't be permuted; a code with one number left has no other."""
    assert "日本@例.com" not in [s for _, s in _surrogates(spark, ["日本@例.com", "a@日.com"])]
    with pytest.raises(RuntimeError, match="no surrogate"):
        found = spark.createDataFrame([("phone", f"1 1{k}") for k in range(10)], "kind string, canonical string")
        pii.retries(found, b"k", pii.workspace(spark))


def test_one_person_has_one_name(spark):
    texts = [
        "Mrs Clara Weber came. Clara Weber left. Mrs Weber spoke; Weber's hat. Clara, then.", "Mr Weber is another's husband. Frau Clara Weber!", "Г-жа Анна Иванова и Г-н Иванов. Иванова ушла.",
        "Dr. Anna-Maria von der Leyen-Smith met Mr O'Brien. O'Brien left with von der Leyen-Smith.", "Weber means weaver here. Clara is a name.",
    ]
    got = {r["doc_id"]: r["text"] for r in _replaced(spark, texts).collect()}
    first, last = re.match(r"Mrs (\w+) (\w+) came", got[0]).groups()
    assert got[0] == f"Mrs {first} {last} came. {first} {last} left. Mrs {last} spoke; {last}'s hat. {first}, then."
    assert got[1] == f"Mr {last} is another's husband. Frau {first} {last}!"
    she = re.match(r"Г-жа (\w+) (\w+ова) и Г-н (\w+ов)\. (\w+) ушла\.", got[2])
    assert she and she[2] == she[4] != she[3] and "Иван" not in got[2]
    d = re.fullmatch(r"Dr\. (\w+)-(\w+) von der (\w+)-(\w+) met Mr (\w+)\. (\w+) left with von der (\w+)-(\w+)\.", got[3])
    assert d and (d[3], d[4]) == (d[7], d[8]) and d[5] == d[6] and not {"Anna", "Leyen", "Smith", "Brien"} & set(re.findall(r"\w+", got[3]))
    assert got[4] == texts[4]  # no title in this text: nobody is known by name


def test_further_kinds(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789, call 030 1234567, 0176-12345678 or 01 23 45 67 89. Not these: 2021-03-04, 01-02-2023, 12:30."
    r = _replaced(spark, [text]).first()
    assert [e["kind"] for e in r["entities"]] == ["iban", "ssn", "phone", "phone", "phone"]
    assert re.sub(r"\d", "0", r["text"]) == re.sub(r"\d", "0", text) and r["text"].endswith(text[text.index("Not") :])
    assert {e.kind for e in pii.detect("DE89 3704 0044 0532 0130 01")} == {"card"}  # wrong check digits: no account, but as long as a card's number
    for e in r["entities"]:
        assert text[e["begin"] : e["end"]] != e["surrogate"] == r["text"][e["begin"] : e["end"]]
    iban = r["entities"][0]["surrogate"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_joined_tries_as_broadcast_ones(spark, monkeypatch):
    texts = _in_texts([f"Mr {a}{b}" for a in ("Alt", "Bar", "Cor") for b in itertools.chain.from_iterable((f"{x}{y}" for x in "aeiou") for y in "lmnrst")] + [f"1.2.3.{k}" for k in range(10)], 7)
    few = {(r["doc_id"], r["text"]) for r in _replaced(spark, texts).collect()}
    monkeypatch.setattr(pii, "BROADCAST_BYTES", -1)
    assert {(r["doc_id"], r["text"]) for r in _replaced(spark, texts).collect()} == few


def test_key(spark):
    docs = spark.createDataFrame([(1, "Mrs Clara Weber, 10.20.30.40")], "doc_id long, text string")
    a, b, c = (pii.replaced(docs, k).first()["text"] for k in (b"k", b"k", b"other"))
    assert a == b != c
    with pytest.raises(ValueError, match="key"):
        pii.replaced(docs, b"")
